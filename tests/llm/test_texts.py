import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import LONG, ODD, SOLID

from tablescope.llm import chat, fingerprints, language, personal_data, sentence_pieces, token_counts, tokenizer_files, toxicity
from tablescope.llm.common import fold
from tablescope.llm.queries import tokenizer_file
from tablescope.llm.shingles import shingles
from pyspark.sql import functions as F

JSON, MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# -- fingerprints


def prints_by_hand(rows):
    docs = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = Counter()
    for here, after in zip(docs, docs[1:] + docs[:1]):
        text, following = here[1] or "", after[1] or ""
        new = fingerprints.edited(text, following)
        out[here[0], len(text), sha(new), fingerprints.to_text(fingerprints.sketch(text)),
            fingerprints.to_text(fingerprints.sketch(new))] += 1
    return out


def test_fingerprints_odd(odd):
    got = fingerprints.fingerprints(odd).collect()
    assert Counter(tuple(r)[:5] for r in got) == prints_by_hand(ODD)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next", "kept_share"))


def test_fingerprints_whole_table(spark, sf001, documents):
    got = Counter(tuple(r)[:5] for r in fingerprints.fingerprints(documents).collect())
    assert got == prints_by_hand([tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_fingerprints_few_rows(spark, none):
    assert fingerprints.fingerprints(none).count() == 0
    one = spark.createDataFrame([(4, "abc def ghi")], "doc_id long, text string")
    r = fingerprints.fingerprints(one).first()
    assert r.edited_sha256 == sha("abc def abc") and r.near_next == 1.0


def test_sketches_merge_and_estimate(monkeypatch):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(6000)]
    a, b = " ".join(words[:4500]), " ".join(words[1500:])
    x, y = fingerprints.sketch(a), fingerprints.sketch(b)
    union = np.unique(np.concatenate([shingles(a), shingles(b)]))
    assert (fingerprints.merge(x, y) == union[:fingerprints.K]).all()
    assert fingerprints.distinct(x) == pytest.approx(4496, rel=0.25)
    assert fingerprints.resemblance(x, y) == pytest.approx(2996 / 5996, abs=0.13)
    assert fingerprints.containment(x, y) == pytest.approx(2996 / 4496, abs=0.15)
    assert (fingerprints.from_text(fingerprints.to_text(x)) == x).all()
    monkeypatch.setattr(fingerprints, "PART", 100)
    assert (fingerprints.sketch(a) == x).all()
    empty = fingerprints.sketch("")
    assert fingerprints.resemblance(empty, empty) == 1 and fingerprints.resemblance(empty, x) == 0


def test_merged_sketches_of_groups(odd):
    prints = fingerprints.fingerprints(odd).join(odd.select("doc_id", "source").distinct(), "doc_id")
    got = {r["source"]: r["hashes"] for r in fingerprints.merged(prints, ["source"]).collect()}
    for s in ("b", "c"):
        every = np.unique(np.concatenate([shingles(r[1] or "") for r in ODD if r[3] == s and r[0] is not None]))
        assert got[s] == [f"{int(h):016X}" for h in every[:fingerprints.K]]


# -- language


def test_language_accuracy(documents):
    profiles = language.learn(documents, fold(documents["doc_id"], 3) != 1)
    got = {r.doc_id: r for r in language.identify(documents, profiles).collect()}
    held = [r for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd(odd, none, documents):
    profiles = language.learn(documents, F.lit(True))
    got = language.identify(odd, profiles).collect()
    letterless = {3, 4, 5, 6, 11}
    assert all((r.lang_pred == "und" and r.score == 0) for r in got if r.doc_id in letterless)
    assert all(r.lang_pred in profiles.languages for r in got if r.doc_id in (1, 2, 8, 9, 10))
    assert language.identify(none, profiles).count() == 0
    nothing = language.learn(none, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_grams_by_hand(monkeypatch):
    text = language.letters("Été à la mer, l'été! 12 été²")
    want = Counter()
    code = lambda s: sum(ord(c) << (21 * (len(s) - 1 - i)) for i, c in enumerate(s))
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            g = text[i:i + n]
            if not (n == 1 and g == " ") and not (n == 3 and g[1] == " "):
                want[code(g)] += 1
    for block in (1 << 18, 4, 7):
        monkeypatch.setattr(language, "BLOCK", block)
        seen, times = language.grams(text)
        assert dict(zip(seen.tolist(), times.tolist())) == want
    assert language.letters("1²3 ½") == "" and language.letters("a²b") == " a b "


def test_out_of_place_by_hand():
    a, b = "the cat sat on the mat with the hat", "le chat est sur le tapis avec le chapeau"
    lists = {k: language.profile(language.letters(t)).tolist() for k, t in (("en", a), ("fr", b))}
    own = language.profile(language.letters("the rat sat")).tolist()
    far = {k: sum(abs(i - x.index(g)) if g in x else language.TOP for i, g in enumerate(own)) for k, x in lists.items()}
    got = language.Profiles(lists).predict("the rat sat")
    assert got == (min(far, key=far.get), pytest.approx(1 - min(far.values()) / (language.TOP * len(own))))


# -- personal data


def base_by_hand(t):
    out = []
    for kind, pattern in ((0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          (2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = re.sub(r"[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0
                    or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_personal_data_base_kinds():
    rnd, anchors = random.Random(8), personal_data.automaton()
    parts = [*"ab.@+-% ()019.1-.@é٣\n", "4111 1111 1111 1111", "1.2.3.4", "255.1", "+1 (930) 555-2361", "a@b.c", "IBAN ", "www."]
    for _ in range(20000):
        t = "".join(rnd.choices(parts, k=rnd.randint(0, 25)))
        assert [s for s in personal_data.spans(t, anchors) if s[1] < personal_data.BASE] == base_by_hand(t), t


@pytest.mark.parametrize("text,want", [
    ("Visit https://ex.com/a?b=1, or www.foo.org.", "url:6:26,url:31:42"), ("see (http://localhost:80/x) now", "url:5:26"),
    ("IBAN: GB82 WEST 1234 5698 7654 32 THE", "account:6:33"), ("IBAN: GB83 WEST 1234 5698 7654 32", ""),
    ("account no. 12345678 x", "account:12:20"), ("accounting 12345678", ""), ("Account 12ab", ""), ("SSN 123-45-6789.", "account:4:15"),
    ("mail a.b@c.de or 10.0.0.255", "email:5:13,ip:17:27"), ("300.1.1.1", ""), ("", "")])
def test_personal_data_spans(text, want):
    assert personal_data.joined(personal_data.spans(text, personal_data.automaton())) == want


def test_personal_data_tables(odd, none, documents):
    for df in (odd, documents):
        got = personal_data.personal_data(df).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter(
            (i, sha(personal_data.joined(base_by_hand(t)))) for i, t in texts)
    assert personal_data.personal_data(none).count() == 0


# -- token counts


def test_pre_tokens_as_the_library():
    from tokenizers import Tokenizer
    import sentencepiece
    rnd, lib = random.Random(1), Tokenizer.from_file(tokenizer_file(JSON))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(MODEL))
    own, pieces = (tokenizer_files.load(tokenizer_files.read(tokenizer_file(f)), f.rpartition(".")[2]) for f in (JSON, MODEL))
    parts = [*"ab'stre VELLmd ,.!?12\n\t\x1c\x85\xa0éÉßİıſKÅ̈ΣσςДд漢字😀ﬁ①²٣\x00\x0b﻿▁", "<|endoftext|>", "<|startoftext|>", "  ", "don't"]
    for _ in range(6000):
        t = "".join(rnd.choices(parts, k=rnd.randint(0, 25)))
        found, special = own.split(t)
        assert special + sum(own.count(p) * n for p, n in found.items()) == len(lib.encode(t, add_special_tokens=False).ids), t
        found, _ = pieces.split(t)
        assert sum(pieces.count(p) * n for p, n in found.items()) == len(sp.encode(t)), t


@pytest.mark.parametrize("common", [token_counts.COMMON, 20])
def test_token_counts(odd, none, documents, monkeypatch, common):
    """Whether pre-tokens take the broadcast or the shuffled join has no bearing on the counts."""
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_counts, "COMMON", common)
    lib = Tokenizer.from_file(tokenizer_file(JSON))
    for df in (odd, documents):
        texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = Counter((i, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in texts)
        got = token_counts.token_counts(df, tokenizer_file(JSON)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(none, tokenizer_file(JSON)).count() == 0


# -- SentencePiece


def scanned(model, text, size):
    """Encoding with a hard cut every ``size`` characters."""
    t = (model.prefix + text).replace(" ", sentence_pieces.MARK)
    borders = [(0, True), *((i, False) for i in range(size, len(t), size)), (len(t), True)]
    own = [model.matrix(t, a, b, o, c) for (a, o), (b, c) in zip(borders, borders[1:])]
    reach = [own[0]]
    for m in own[1:]:
        reach.append(sentence_pieces.combined(reach[-1], m))
    # associative: the product from the right ends in the same weight
    right = own[-1]
    for m in reversed(own[:-1]):
        right = sentence_pieces.combined(m, right)
    assert {(x, z): pytest.approx(w) for x, z, w in right} == {(x, z): w for x, z, w in reach[-1]}
    to, out = (0, ""), []
    for i in range(len(own) - 1, -1, -1):
        before = {y: w for _, y, w in reach[i - 1]} if i else {(0, ""): 0.0}
        start = max((before.get(x, sentence_pieces.NEVER) + w, x) for x, y, w in own[i] if y == to)[1]
        out.append(model.trace(t, borders[i][0], borders[i + 1][0], start, to, borders[i + 1][1]))
        to = start
    return [i for ids in reversed(out) for i in ids]


@pytest.mark.parametrize("unigram", [False, True])
def test_scan_equals_library(unigram):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto
    spec = proto.ModelProto.FromString(tokenizer_files.read(tokenizer_file(MODEL)))
    if unigram:         # the same pieces with scores of a probability model; distinct, so that few paths tie
        spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
        rnd = random.Random(9)
        for p in spec.pieces:
            p.score = -rnd.uniform(3, 12) - len(p.piece) / 9 if p.type == p.NORMAL else p.score
    model = sentence_pieces.Model(spec.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    rnd, parts = random.Random(3), [*"abcdethinorsel" * 3, *"  ▁\nÉé漢😀12.,", "the", "ing", "tion", "  ", "        "]
    for i in range(150):
        t = "".join(rnd.choices(parts, k=rnd.randint(1, 120)))
        got, want = scanned(model, t, 20 if i % 2 else 33), lib.encode(t)
        if unigram and got != want:             # only an equally good path may differ
            assert lib.decode(got) == lib.decode(want)
            assert sum(map(lib.get_score, got)) == pytest.approx(sum(map(lib.get_score, want)), abs=1e-3)
        else:
            assert got == want, t


def test_every_chunk_of_a_giant_has_a_matrix(spark, monkeypatch):
    """Matrices of all chunks, products of few up to one a document, states back down; the ids are the library's."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.length("text") > sentence_pieces.CHUNK)
    rnd = random.Random(3)
    solid = ["".join(rnd.choice("aehinst") for _ in range(3000)), "ab" * 1700, "x" * 2500 + " word " + "é" * 900]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(solid)], "doc_id long, text string"))
    seen = []
    monkeypatch.setattr(sentence_pieces, "FAN", 3)
    whole = sentence_pieces.levels
    monkeypatch.setattr(sentence_pieces, "levels", lambda nodes: seen.append(whole(nodes)) or seen[-1])
    got = sentence_pieces.encode(docs, tokenizer_file(MODEL), ["doc_id"], 600).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(MODEL))
    assert {r.doc_id: r.ids for r in got} == {i: lib.encode(t) for i, t in texts.items()}
    chunks = sum(len(sentence_pieces.cuts(" " + t, 600)) - 1 for t in texts.values())
    sizes = [level.count() for level in seen[0]]
    assert sizes[0] == chunks > 1000 and sizes[-1] == len(texts) and len(sizes) > 4
    assert all(r.matrix for level in seen[0] for r in level.collect())
    assert seen[0][0].where("size(matrix) > 1").count() > 5                  # borders that pieces may cross


@pytest.mark.parametrize("chunk", [sentence_pieces.CHUNK, 500])
def test_encode_decode(spark, odd, none, chunk):
    import sentencepiece
    path = tokenizer_file(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    more = [(20, "the" * 9000), (21, " " * 20000 + "z"), (22, "漢字😀" * 6000), (23, SOLID + " " + SOLID), (24, LONG)]
    both = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sentence_pieces.decode(sentence_pieces.encode(both, path, ["doc_id"], chunk), path).collect()
    texts = [(r[0], r[1] or "") for r in ODD] + more
    assert Counter((r.doc_id, tuple(r.ids), r.text, r.text_sha256) for r in got) == Counter(
        (i, tuple(lib.encode(t)), t, sha(t)) for i, t in texts)
    once = sentence_pieces.encode(both, path, ["doc_id"], chunk, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in once) == Counter((r.doc_id, tuple(r.ids), r.text) for r in got)
    assert sentence_pieces.encode(none, path, ["doc_id", "ids", "size"]).count() == 0


# -- chat


def test_perspectives_by_hand(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, None, "ann", "late"), (1, 3, None, "who?"),
            (2, 0, "system", "alone"), (None, 5, "cy", "x"), (None, 4, "cy", "x"), (3, 0, "ann", ""), (3, 0, "ann", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(3)
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cy"), (3, "ann")}
    r = got[1, "ann"]
    assert r.text == ("<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
                      "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nwho?<|im_end|>\n"
                      "<|im_start|>assistant\nlate<|im_end|>\n")
    assert [r.text[m.start:m.end] for m in r.masks] == ["hi < |im_end|><|im_end|>\n", "late<|im_end|>\n"]
    assert [got[3, "ann"].text[m.start:m.end] for m in got[3, "ann"].masks] == ["<|im_end|>\n"] * 2
    assert chat.perspectives(df.limit(0)).count() == 0


def test_long_dialogue_in_parts(spark):
    rows = [(7, i, "ab"[i % 2], f"m{i}") for i in range(1000)] + [(8, 0, "a", "x")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    for who in "ab":
        parts = sorted((r.part, r.n_turns, r.text) for r in got if r.conv_id == 7 and r.perspective == who)
        assert [p[:2] for p in parts] == [(0, 256), (1, 256), (2, 256), (3, 232)]
        whole, _ = chat.render([{"speaker": r[2], "content": r[3]} for r in rows[:1000]], who)
        assert "".join(p[2] for p in parts) == whole


def test_word_borders_of_any_script():
    from tablescope.llm.shingles import bordered, word_hashes
    same = lambda a, b: np.array_equal(word_hashes(a), word_hashes(b))
    assert same("He said “no”—twice…", "he said no twice") and same("a\u00a0b\u2003c", "a b c") and same("«Été»", "été")
    assert len(word_hashes("汉字很多。没有空格")) == 8 and same("汉字，很", "汉 字 很") and len(word_hashes("ภาษาไทย")) >= 5
    assert len(word_hashes("हिन्दी में")) == 2 and len(word_hashes("любовь, мир")) == 2 and len(word_hashes("تعليم الآن")) == 2
    assert len(word_hashes("😀 😀")) == 2 and len(word_hashes("…")) == 1 and len(word_hashes(" \u3000")) <= 1
    assert bordered("naïve Straße œuvre") == "naïve Straße œuvre"


def test_a_changed_character_leaves_a_text_without_spaces_alike(spark):
    from tablescope.llm import near_dedup
    rnd = random.Random(4)
    text = "".join(chr(rnd.randrange(0x4e00, 0x9000)) for _ in range(208))
    other = text[:100] + "的" + text[101:]
    rows = spark.createDataFrame([(1, text), (2, other), (3, text[::-1]), (4, "He said “no” to it " * 20), (5, 'He said "no" to it ' * 20)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(rows).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_ranges_have_partitions_of_their_own(spark):
    for n in (1, 8, 51):
        key = fingerprints.one_a_partition(spark, F.col("id"), n)
        parts = spark.range(0, n).repartition(n, key).select(F.spark_partition_id()).distinct().count()
        assert parts == n


# -- toxicity


@pytest.fixture(scope="module")
def index(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, toxicity.learn(docs, labels, fold(F.col("doc_id"), 4) != 2)


def toxicity_by_hand(rows, toxic, chosen, per_label=toxicity.PER_LABEL, nearest=15):
    """Scores of all rows by definition. rows: texts by identifier; toxic:
    labels by identifier; chosen: the examples in the order of their hashes."""
    import math
    words = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t in rows.items()}
    n = Counter(toxic[i] for i in chosen)
    held = {label: Counter(w for i in chosen if toxic[i] == label for w in words[i]) for label in (0, 1)}

    def weight(w):
        a, b = held[0][w], held[1][w]
        g = 0.0
        for seen, of, every in ((a, n[0], a + b), (b, n[1], a + b), (n[0] - a, n[0], len(chosen) - a - b), (n[1] - b, n[1], len(chosen) - a - b)):
            g += seen * math.log(seen * len(chosen) / (every * of)) if seen else 0.0
        lean = math.sqrt(1 + 2 * max(g, 0)) if b * n[0] > a * n[1] else 1.0
        return (math.log((1 + len(chosen)) / (1 + a + b)) + 1) * lean

    weights = {w: weight(w) for w in held[0] + held[1]}

    def vector(i):
        v = {w: (1 + math.log(k)) * weights[w] for w, k in words[i].items() if w in weights}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(i) for i in rows}
    sizes = Counter(toxic.values())
    each = {label: sizes[label] / n[label] for label in n}

    def near(i, but=None):
        cosines = [(-round(sum(x * vectors[e].get(w, 0) for w, x in vectors[i].items()), 12), k, e) for k, e in enumerate(chosen) if e != but]
        return [(e, -c) for c, _, e in sorted(cosines)[:nearest] if c < 0]

    def vote(found):
        parts = [(each[toxic[e]] / (1 - min(c, 1) + 0.05), toxic[e]) for e, c in found]
        return sum(v * y for v, y in parts) / sum(v for v, _ in parts) if parts else 0.0

    with_words = [e for e in chosen if vectors[e]]
    steps, levels = toxicity.isotonic(np.array([vote(near(e, e)) for e in with_words]), np.array([float(toxic[e]) for e in with_words]),
                                      np.array([each[toxic[e]] for e in with_words]))
    rest = [e for e in chosen if not vectors[e]]
    without = sum(each[toxic[e]] * toxic[e] for e in rest) / sum(each[toxic[e]] for e in rest) if rest else 0.0
    out = {}
    for i in rows:
        found = near(i)
        out[i] = (float(np.interp(vote(found), steps, levels)) if found else without, found)
    return out


@pytest.mark.parametrize("per_label", [toxicity.PER_LABEL, 40])
def test_toxicity_by_hand(spark, per_label):
    """The whole result, from the sample of examples to the calibrated scores."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    usable = fold(F.col("doc_id"), 4) != 2
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    known = labels.where(usable & F.col("toxic").isNotNull()).select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)).alias("u"))
    known = sorted((r.u, r.doc_id, r.toxic) for r in known.collect())
    chosen = [i for label in (0, 1) for i in [k[1] for k in known if k[2] == label][:per_label]]
    chosen = [k[1] for k in known if k[1] in set(chosen)]
    want = toxicity_by_hand(rows, {k[1]: k[2] for k in known}, chosen)
    got = toxicity.score(docs, toxicity.learn(docs, labels, usable, per_label)).collect()
    assert len(got) == len(want)
    for r in got:
        score, near = want[r.doc_id]
        assert [c for _, c in near] == pytest.approx([e.cosine for e in r.evidence], abs=1e-9)
        if [e for e, _ in near] == [e.doc_id for e in r.evidence]:                   # else cosines that tie in all but the last bits
            assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == (score >= 0.3)
    assert np.mean([[e for e, _ in want[r.doc_id][1]] == [e.doc_id for e in r.evidence] for r in got]) > 0.99


def test_search_is_exact_and_skips_blocks(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    ix = toxicity.learn(docs, labels, fold(F.col("doc_id"), 4) != 2)
    dense = np.zeros((len(ix.words), len(ix.ids)), np.float32)
    for place in range(len(ix.ids)):
        own = slice(ix.ends[place], ix.ends[place + 1])
        dense[ix.held[own], place] = ix.weight[own]
    vectors = [ix.vector(toxicity.words_of(r.text)) for r in docs.select("text").limit(300).collect()]
    found, scored = ix.searches_counted(vectors)
    for (terms, weights), (places, cosines) in zip(vectors, found):
        every = weights @ dense[terms]
        assert np.allclose(cosines, np.sort(every[every > 0])[::-1][:ix.nearest], atol=1e-5)
    assert scored < 0.8 * len(vectors) * ix.blocks                  # a fair part of the blocks is never scored


def test_toxicity_held_out(spark):
    """On the larger table, which holds out over a hundred toxic documents."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    ix = toxicity.learn(docs, labels, fold(F.col("doc_id"), 4) != 2)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.score, toxic[r.doc_id], r.predicted) for r in toxicity.score(docs, ix).collect()
           if r.doc_id in toxic and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    bad, good = [s for s, t, _ in got if t], [s for s, t, _ in got if not t]
    assert np.mean([[(b > g) + (b == g) / 2 for g in good] for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in bad]) > 0.9 and np.mean([s >= 0.3 for s in good]) < 0.03
    assert all(p == (s >= 0.3) and 0 <= s <= 1 for s, _, p in got)


def test_toxicity_odd(index, odd, none, spark):
    docs, labels, ix = index
    got = toxicity.score(odd, ix).collect()
    assert len(got) == len(ODD) and all(r.score == ix.without and not r.evidence for r in got if r.doc_id in (3, 4, 5, 6, 11))
    assert toxicity.score(none, ix).count() == 0
    assert toxicity.kept(none, ix).count() == 0 and toxicity.kept(odd, ix).columns == odd.columns
    odd_labels = spark.createDataFrame([(1, 1, None), (1, 1, 1), (None, 0, 0), (2, 0, 7), (10, 0, 0)], "doc_id long, quality int, toxic int")
    few = toxicity.learn(odd, odd_labels, F.lit(True))
    assert toxicity.score(odd, few).count() == len(ODD)
    nothing = toxicity.learn(odd, odd_labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_every_word_of_the_examples_is_searched(index):
    """No word of an example is left out, and every document that shares one has neighbours."""
    docs, labels, ix = index
    toxic = {r.doc_id for r in labels.collect() if r.toxic is not None}
    rows = {r.doc_id: toxicity.words_of(r.text or "") for r in docs.collect()}
    held = set().union(*(t for i, t in rows.items() if i in toxic and zlib.crc32(str(i).encode()) % 4 != 2))
    assert set(ix.words.to_pylist()) == held and len(ix.idf) == len(held) and (ix.idf >= 1).all()
    near = {r.doc_id: len(r.evidence) for r in toxicity.score(docs, ix).collect()}
    assert {i for i, n in near.items() if n} == {i for i, t in rows.items() if held & set(t)}


def test_isotonic():
    steps, levels = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0., 1., 0., 1.]), np.array([1., 1., 3., 1.]))
    assert levels.tolist() == [0.0, 0.25, 1.0] and steps[1] == pytest.approx(1.1 / 4)


# -- the registered queries and the pipeline


def test_llm_entry():
    import __spark_entry__ as e
    names = {n for n in e.queries() if n.startswith("op")}
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in e.queries()


def test_pipeline(spark, sf001, tmp_path):
    """Every stage on what the one before kept; decisions by hand."""
    import corpus_pipeline as c
    import sentencepiece
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    ix = toxicity.learn(docs, spark.read.parquet(f"{sf001}/labels.parquet"), fold(F.col("doc_id"), 4) != 2)
    stays = {r.doc_id for r in toxicity.score(docs, ix).collect() if not r.predicted}
    frames = []
    for i, (_, stage) in enumerate(c.STAGES):
        path = os.path.join(tmp_path, str(i))
        stage(spark, docs, sf001).write.parquet(path)
        docs = spark.read.parquet(path)
        frames.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in frames[0]} == stays
    least: dict = {}
    for i in sorted(stays):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text), i)
    assert {r.doc_id for r in frames[1]} == set(least.values())
    from test_dedup_and_mix import classes_by_hand, mix_truth
    classes = classes_by_hand([(r.doc_id, r.text) for r in frames[1]])
    assert {r.doc_id for r in frames[2]} == {min(ids) for ids in classes.values()}
    taken = {r[0]: r[4] for r in mix_truth([(r.doc_id, r.text, None, r.source) for r in frames[2]])}
    words = Counter()
    for r in frames[3]:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert +words == +Counter(taken)
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(MODEL))
    assert Counter((r.doc_id, tuple(r.ids)) for r in frames[4]) == Counter((r.doc_id, tuple(lib.encode(r.text))) for r in frames[3])
    assert all(r.round_trip == ("▁" not in r3) for r, r3 in ((r, before[r.doc_id].text) for r in frames[4])) and any(r.round_trip for r in frames[4])
    assert Counter((r.doc_id, tuple(r.ids)) for r in c.run(spark, sf001).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in frames[4])


def test_slices_are_few_bytes():
    """Long texts go a few at a time, whatever their number; a row is never cut."""
    import pyarrow as pa

    from tablescope.llm.common import SLICE_BYTES, slices

    texts = ["x" * n for n in [10, 3 * SLICE_BYTES, *[SLICE_BYTES // 3] * 40, 5]]
    batch = pa.record_batch({"text": pa.array(texts)})
    parts = list(slices([batch, batch.slice(0, 0)]))
    assert [x for p in parts for x in p["text"].to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= SLICE_BYTES for p in parts) and max(p.num_rows for p in parts) > 1
