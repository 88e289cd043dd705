"""Spelling variants, periodic runs and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tablescope.llm import packing, periodic_runs, queries, spelling, tokenizer_files
from tablescope.llm.queries import tokenizer_file

JSON = "word_bpe_49k.json"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# -- spelling variants


def words_by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def variants_by_hand(n):
    near, by_size = defaultdict(list), defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    for w in n:
        near[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size[size] if v != w and one_edit(v, w)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_near_words_share_a_signature():
    rnd, signed = random.Random(3), spelling.Signatures()
    for _ in range(3000):
        word = "".join(rnd.choice("abcéàz") for _ in range(rnd.randint(5, 12)))
        at, c = rnd.randrange(len(word)), rnd.choice("abcéà")
        for other in (word[:at] + c + word[at:], word[:at] + word[at + 1:], word[:at] + c + word[at + 1:]):
            short, long = sorted((word, other), key=len)
            a, b = set(signed.of(short)), set(signed.of(long))
            if len(short) == len(long):
                assert {k for r, k in a if r == 0} & {k for r, k in b if r == 0}
            else:
                assert {k for r, k in a if r == 1} & {k for r, k in b if r == 2}


def test_variants_of_random_words(spark):
    rnd = random.Random(8)
    n = {"".join(rnd.choice("abé") for _ in range(rnd.randint(5, 7))): rnd.choice([3, 4, 7, 8, 16, 40]) for _ in range(600)}
    got = spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(4))
    assert rows_of(got) == variants_by_hand(n)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Small tables, as Spark sees them: a word's 26 signatures as one row, Parquet files by their bytes."""
    plans = {}

    def ran(df, name):
        df.collect()                                    # the plan as it ended, with what Spark changed meanwhile
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    written = spelling.written
    monkeypatch.setattr(spelling, "written", ran)
    n = {"wordy": 3, "words": 6, "wards": 12, "yards": 24, "other": 5}
    words = ran(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")), "result")
    assert rows_of(words) == variants_by_hand(n)
    assert {"forms", "roots", "result"} <= set(plans)
    assert all("SortMergeJoin" in plans[name] for name in ("forms", "roots", "result"))
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]


def test_variants_of_documents(spark, sf001, documents):
    by_hand = variants_by_hand(words_by_hand([tuple(r) for r in documents.select("doc_id", "text").collect()]))
    assert rows_of(queries.op11_spelling_variants(spark, sf001)) == by_hand
    assert any(r[1] for r in by_hand)


def test_words_odd(odd, none):
    want = words_by_hand([r[:2] for r in ODD])
    assert rows_of(spelling.word_counts(odd, spelling.one_letter_less)) == Counter(want.items())
    assert rows_of(spelling.spelling_variants(spelling.word_counts(odd, spelling.one_letter_less))) == variants_by_hand(want)
    assert spelling.spelling_variants(spelling.word_counts(none)).collect() == []


# -- periodic runs


def runs_by_hand(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        j = 0
        while j < len(w) - q:
            if w[j] != w[j + q]:
                j += 1
                continue
            start = j
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j - start + q
            if size >= max(6, 4 * q) and all(any(w[start + i] != w[start + i + p] for i in range(size - p)) for p in range(1, q)):
                out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_built_texts():
    rnd = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(20):
            letters, words = rnd.choice([1, 2, 2, 3, 5, 50]), []
            for _ in range(rnd.randint(0, 6)):
                words += [rnd.randrange(letters) for _ in range(rnd.randint(0, 20))]
                root = [rnd.randrange(letters) for _ in range(rnd.randint(1, rnd.choice([3, 8, 40])))]
                root = root[:2] * rnd.randint(1, 9) + root if rnd.random() < 0.4 else root     # short periods within long ones
                words += (root * 7)[:rnd.randint(0, len(root) * 6)]
            texts.append([b"%d" % x for x in words])
        a, b = [b"a"], [b"a", b"b"]
        while len(b) < 300:
            a, b = b, b + a
        texts.append(b)                                                                         # squares at all scales
        assert periodic_runs.runs_of(texts) == [runs_by_hand(t) for t in texts]


def digests_by_hand(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark, sf001, documents):
    want = Counter(digests_by_hand(*r) for r in documents.select("doc_id", "text").collect())
    assert rows_of(queries.op12_periodic_runs(spark, sf001)) == want
    assert any(r[1] for r in want)


def test_runs_odd(spark, odd, none):
    got = [tuple(r) for r in periodic_runs.periodic_runs(odd).select("doc_id", "n_words", "runs", "collapsed").collect()]
    # the long line repeats five words (and its copy ends otherwise): too long for the brute force above
    long = {8, 12}
    words = {(d, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in ODD}
    want = Counter((d, len(w), tuple(runs_by_hand(w)) if d not in long else ((0, 9000 * 6, 6),)) for (d, t), w in
                   ((k, words[k]) for k in [r[:2] for r in ODD]))
    assert Counter((d, n, tuple(tuple(r) for r in runs)) for d, n, runs, _ in got) == want
    assert {c for d, _, _, c in got if d == 12} == {"many words in a long line end"}
    assert periodic_runs.periodic_runs(none).collect() == []


# -- packing


def test_closest_sum_by_enumeration():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(0, 120)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        used = packing.closest_sum(counts, room)
        assert all(0 < v <= counts[k] for k, v in used.items())
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)


def check_packed(rows, ids_of, capacity):
    """rows: pieces; ids_of: the documents' ids (a list, in any order)."""
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_document[r["doc_id"]].append(r)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and 0 < r["length"] == len(r["ids"]) // 4
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & at - 1 == 0 else capacity - at
    assert padding == 0
    want = defaultdict(Counter)
    for doc, ids in ids_of:
        want[doc][ids] += 1
    got = defaultdict(Counter)
    for doc, own in by_document.items():
        # pieces of several documents of one identifier: each continues a piece that ends where it starts
        open_ends = []
        for r in sorted(own, key=lambda r: r["start"]):
            if r["start"] == 0:
                open_ends.append((r["doc_tokens"], bytes(r["ids"])))
                continue
            fitting = [x for x in open_ends if x[0] == r["doc_tokens"] and len(x[1]) // 4 == r["start"]
                       and any(i.startswith(x[1] + bytes(r["ids"])) for i in want[doc])]
            assert fitting
            open_ends.remove(fitting[0])
            open_ends.append((r["doc_tokens"], fitting[0][1] + bytes(r["ids"])))
        for n, ids in open_ends:
            assert len(ids) // 4 == n
            got[doc][ids] += 1
    assert got == want


def library_ids(rows, closing=2):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_file(JSON))
    return [(d, np.array(library.encode(t or "", add_special_tokens=False).ids + [closing], "<u4").tobytes()) for d, t in rows]


@pytest.mark.parametrize("capacity, window", [(4096, 4096), (64, 8), (256, 30)])
def test_packed_documents(documents, capacity, window):
    rows = packing.pack(documents, tokenizer_file(JSON), 2, capacity, window).collect()
    check_packed(rows, library_ids([tuple(r) for r in documents.select("doc_id", "text").collect()]), capacity)


def test_packed_odd(odd, none):
    check_packed(packing.pack(odd, tokenizer_file(JSON), 2).collect(), library_ids([r[:2] for r in ODD]), 4096)
    assert packing.pack(none, tokenizer_file(JSON), 2).collect() == []


def test_packing_cuts_little():
    rnd = random.Random(6)
    documents = [(i, bytes(4 * max(1, int(rnd.lognormvariate(5, 1))))) for i in range(5000)]
    sequences = list(packing.sequences(iter(documents)))
    pieces = sum(map(len, sequences)) - sum(len(ids) // 4 // 4096 for _, ids in documents)
    assert pieces <= 5000 + 40
    assert all(n & n - 1 == 0 for n in (sum(len(p[2]) // 4 for p in s) for s in sequences))


def test_equal_lengths_pack_without_padding():
    sequences = list(packing.sequences(((i, bytes(4 * 3000)) for i in range(1000)), window=64))
    sizes = [sum(len(p[2]) // 4 for p in s) for s in sequences]
    assert sum(sizes) == 3000 * 1000 and all(n & n - 1 == 0 for n in sizes) and sizes.count(4096) == 3000 * 1000 // 4096


def test_packing_digests(spark, sf001, documents):
    got = queries.op13_packing(spark, sf001)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = {d: zlib.crc32(ids) for d, ids in library_ids([tuple(r) for r in documents.select("doc_id", "text").collect()])}
    uncut = got.where(F.col("length") == F.col("doc_tokens")).collect()
    assert uncut and all(r["ids_crc32"] == whole[r["doc_id"]] for r in uncut)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|> a <|startoftext|>", "İstanbul ŞIŞLI ǅ", "a b c", "漢字 😀 é",
                                  "It's I'LL don't 'sss 12ab3", "x" * 300 + " ÀÉ÷×ß"])
def test_ids_of_texts(text):
    encoder = tokenizer_files.Ids(tokenizer_files.read(tokenizer_file(JSON)))
    assert (None, encoder.of(text) + encoder.of("") + b"\2\0\0\0") == library_ids([(None, text)])[0]
