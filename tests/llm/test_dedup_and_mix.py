import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ODD

from tablescope.llm import components, exact_dedup, mixing, near_dedup, probminhash
from tablescope.llm.shingles import of_words, shingles, word_hashes


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_truth(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in [*known, *[None] * (len(ids) - len(known))]:
            out[i, keep, len(ids), first, sha] += 1
            first = False
    return out


def test_exact_dedup_odd(odd):
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(odd).collect()) == exact_truth(ODD)


def test_exact_dedup_hot_group_over_many_ranges(spark):
    """Two thirds of the rows are one text; it is dealt over several ranges and still one group."""
    rows = [(i, "the same  words" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(df).collect()) == exact_truth(rows)


def test_deduplicated_keeps_columns(odd):
    out = exact_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    assert Counter(norm(r["text"]) for r in out.collect()) == Counter({norm(r[1]) for r in ODD})


def test_empty_tables(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.deduplicated(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert near_dedup.near_classes(none).count() == 0
    assert near_dedup.near_dedup(none).count() == 0


def water(sizes, weights):
    """Sharing the excess again and again."""
    total, target = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    stopped = set()
    while True:
        live = [s for s in sizes if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        for s in live:
            target[s] = left * weights[s] / sum(weights[x] for x in live)
        above = [s for s in live if target[s] > 3 * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = 3.0 * sizes[s]
        stopped |= set(above)


def mix_truth(rows):
    docs = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")),
             hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()) for r in rows]
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    sizes = {s: sum(d[2] for d in docs if d[1] == s) for s in names}
    target, out = water(sizes, weights), []
    for s in names:
        budget, before = round(target[s]), 0
        for d in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] is not None, d[0] or 0, d[2])):
            whole, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
            out.append((d[0], d[2], sizes[s], target[s], whole * d[2] + min(max(rest - before, 0), d[2])))
            before += d[2]
    return out


def close(rows):
    return sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in rows)


def test_mix_odd(odd):
    assert close(mixing.mix(odd).collect()) == close(mix_truth(ODD))


@pytest.mark.parametrize("shares", [(900, 5, 5, 90), (1, 1, 1000), (10,), (7, 0, 300, 20, 20)])
def test_mix_targets(spark, shares):
    rows = [(i * 1000 + j, "w " * (1 + j % 7), None, f"s{i}" if i else None) for i, n in enumerate(shares) for j in range(n)]
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string").repartition(6)
    got, want = mixing.mix(df).collect(), mix_truth(rows)
    assert close(got) == close(want)
    for src in {r[3] for r in rows}:
        mine = {r[0] for r in rows if r[3] == src}
        taken, target = sum(r.taken for r in got if r.doc_id in mine), next(r.target for r in got if r.doc_id in mine)
        assert abs(taken - target) <= 0.5
    assert all(r.taken <= 3 * r.size for r in got)


def test_mixed_documents(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    want = Counter()
    for r in mix_truth(ODD):
        want[r[0]] += r[4]
    # \x00 and the like are words too; the texts here have no other separators
    assert +words == +want


def test_shingles_in_blocks(monkeypatch):
    from tablescope.llm import shingles as s
    text = "Some words, repeated words and MORE words here. " * 200
    whole = word_hashes(text)
    monkeypatch.setattr(s, "BLOCK", 100)
    assert (word_hashes(text) == whole).all()
    assert len(whole) == 8 * 200 and len(shingles(text)) == len(whole) - 4
    assert len(shingles("only three words")) == 1 and not len(shingles(" \n")) and len(shingles("*** !!!")) == 1


def test_probability_jaccard_estimate():
    rng = np.random.default_rng(5)
    items = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    a, b = np.sort(items[:300]), np.sort(items[60:])
    u, v = rng.integers(1, 9, 300), rng.integers(1, 9, 340)
    plain, weighted = probminhash.similarity((a, u), (b, v))
    assert plain == pytest.approx(len(np.intersect1d(a, b)) / 400)
    wa, wb = dict(zip(a.tolist(), u.tolist())), dict(zip(b.tolist(), v.tolist()))
    want = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in {*wa, *wb}) for d in wa if d in wb)
    assert weighted == pytest.approx(want)
    agree = (probminhash.signature(a, u.astype(float), 4800) == probminhash.signature(b, v.astype(float), 4800)).mean()
    assert agree == pytest.approx(want, abs=0.03)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 70), (5, 5), (7, None)] + [(200, 200 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 100: 60, 70: 60, **{200 + i: 200 for i in range(1, 300)}}


def classes_by_hand(rows):
    """All pairs, exactly."""
    sets = {}
    for n, (i, t) in enumerate(rows):
        x, c = np.unique(shingles(t or ""), return_counts=True)
        sets[n] = (x, c)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and max(probminhash.similarity(sets[a], sets[b])) >= 0.8:
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for n in sets:
        members[root(n)].append(rows[n][0])
    return members


def by_hand(rows):
    out = Counter()
    for ids in classes_by_hand(rows).values():
        known = sorted(i for i in ids if i is not None)
        for j, i in enumerate([*known, *[None] * (len(ids) - len(known))]):
            out[i, known[0] if known else None, len(ids), j == 0] += 1
    return out


def test_near_classes_odd(odd):
    got = Counter(tuple(r) for r in near_dedup.near_classes(odd).drop("code").collect())
    assert got == by_hand([(r[0], r[1]) for r in ODD])


def test_near_classes_against_all_pairs(spark, monkeypatch):
    """Copies, near copies of one base that are not all alike, chains and short
    texts; blocks are made small so that buckets span several."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 5000)}"
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(60):                          # edits of one base, up to ten words
        t = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 11)):
            t[at] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for _ in range(12):                          # each a little further from the first
        chain = list(chain)
        chain[rng.integers(0, 100)] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(50)) for _ in range(40)]
    texts += ["short text", "Short text!", "short", "", None, texts[0], texts[0].upper(), texts[70]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in near_dedup.near_classes(df).drop("code").collect())
    assert got == by_hand(rows)


def test_near_classes_by_plain_similarity_alone(spark, monkeypatch):
    """Copies with passages repeated many times: plain similarity 0.97, weighted
    0.17; one repeats in both texts, and blocks are small."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = []
    for n in range(6):
        text = " ".join(f"w{n}x{i}" for i in range(404))
        loud = " ".join(f"l{n}x{i}" for i in range(10))
        other = " ".join(f"o{n}x{i}" for i in range(10))
        rows += [(10 * n, text), (10 * n + 1, f"{text} " + " ".join([loud] * 200))]
        if n > 2:
            rows += [(10 * n + 2, f"{text} " + " ".join([other] * 150)), (10 * n + 3, f"{text} {text}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in near_dedup.near_classes(df).drop("code").collect())
    assert got == by_hand(rows) and {r[2] for r in got} == {2, 4}


def test_near_dedup_keeps_columns(odd):
    out = near_dedup.near_dedup(odd)
    assert out.columns == odd.columns
    kept = near_dedup.near_classes(odd).where("kept").select("doc_id")
    assert Counter(r[0] for r in out.select("doc_id").collect()) == Counter(r[0] for r in kept.collect())


def test_of_words_is_order_sensitive():
    a = word_hashes("a b c d e f")
    assert of_words(a)[0] != of_words(a[::-1])[0]
