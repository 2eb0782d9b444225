"""Jaccard links and repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from weirflow.llm import jaccard_join, suffix_dedup
from weirflow.llm.components import components

DOCS = "doc_id long, text string, cls string, rid int, h int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d if d is not None else -1, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=-1)) for i, (d, _) in enumerate(rows))


def corpus(rng, n_bases=25, copies=8, words=60):
    vocab = [f"w{i}" for i in range(4000)]
    common = " ".join(rng.choices(vocab, k=12))
    rows = []
    for b in range(n_bases):
        base = rng.choices(vocab, k=rng.choice([3, 8, words, words * 3]))
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
            if rng.random() < 0.4:
                text = f"{common} {text}"
            rows.append(text.upper() if rng.random() < 0.1 else text)
    return rows


@pytest.mark.parametrize(("k", "percent", "seed", "rounds", "group"), [(4, 85, 1, 2, 300), (5, 80, 2, 0, 200), (4, 85, 3, 1, 500)])
def test_links(spark, k, percent, seed, rounds, group, monkeypatch):
    """Groups of a few classes, and no or one round of them, so that the matrix has links to find."""
    rng = random.Random(seed)
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    if not rounds:  # a loop that never runs leaves nothing apart: one round of single classes does
        monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
        monkeypatch.setattr(jaccard_join, "GROUP", 1)
        monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    rows = list(enumerate(corpus(rng)))
    base = " ".join(f"b{i}" for i in range(80)).split()
    for _ in range(60):  # one group far beyond the size of a task's group
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            w[rng.randrange(80)] = f"e{rng.randrange(10_000)}"
        rows.append((len(rows), " ".join(w)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 4, "one"), (n + 6, "é Ö"), (n + 7, "é ö"), (n + 8, "long " * 30_000)]
    rows += [(n + 9, rows[0][1]), (n + 10, rows[0][1])]
    got = jaccard_join.link_documents(table(spark, rows), words=k, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, percent)


def test_links_with_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MIN_FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "COUNTED_SHARE", 0.9)
    rows = list(enumerate(corpus(random.Random(9))))
    got = jaccard_join.link_documents(table(spark, rows), words=4, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)


@pytest.mark.parametrize("bits", [1 << 30, 16])
def test_links_move_sets_to_groups_only(spark, bits, monkeypatch):
    """Sets reach their table without a shuffle while the filters hold the classes (16: they don't), and each
    round's groups and the matrix's with one exchange for the sets; links stay whole either way."""
    from weirflow.llm import common

    plans = {}

    def seen(df, label, *more, real=jaccard_join.staged):
        plans.setdefault(label, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df, label, *more)

    monkeypatch.setattr(jaccard_join, "staged", seen)
    monkeypatch.setattr(jaccard_join, "GROUP", 500)
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = list(enumerate(corpus(random.Random(4))))
    rows += [(None, rows[0][1]), (len(rows), rows[0][1])]
    got = jaccard_join.link_documents(table(spark, rows), words=4, percent=85).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)
    assert ("Join" in plans["sets"][0]) == (bits == 16)
    assert "ArrowEvalPython" not in plans["sets"][0]  # with MapInArrow it would take a second Python worker to a task
    for plan in plans["links"]:
        assert "SortMergeJoin" not in plan or "MapInArrow" in plan  # the matrix joins sets with where they go, once


def test_most_frequent_fits_or_is_left_out(spark):
    """Many ties at the top level never exceed the room."""
    counts = spark.createDataFrame([(i, 1 << 20) for i in range(50)] + [(100 + i, 40) for i in range(5)] + [(200, 3)], "h long, n long")
    for room, want in ((60, 55), (55, 55), (54, 50), (50, 50), (49, 0), (0, 0)):
        h, n = jaccard_join.most_frequent(counts, room)
        assert len(h) == len(n) == want and sorted(h.tolist()) == h.tolist()


def test_links_empty_and_drop(spark):
    assert jaccard_join.link_documents(table(spark, [])).count() == 0
    text = " ".join(f"t{i}" for i in range(100))
    docs = table(spark, [(5, text), (3, text + " more"), (9, "else"), (None, None), (7, None)])
    left = jaccard_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {3, 9, None, 7}


def test_drop_with_null_and_repeated_ids(spark):
    """One row of a component stays whatever its ids; a row that only shares its id with a copy stays."""
    a, b = " ".join(f"t{i}" for i in range(100)), " ".join(f"u{i}" for i in range(100))
    rows = [(5, a), (None, a + " x"), (None, a), (5, a + " y"), (9, a + " z"), (9, "a lone text"), (5, "another lone text"), (None, b), (None, b + " w"), (4, "same"), (4, "same"), (6, None), (6, None)]
    left = sorted((r.doc_id or -1, r.text or "") for r in jaccard_join.drop_near_copies(table(spark, rows)).collect())
    near = [x for x in left if x[1].startswith("t0")]
    assert len(near) == 1 and near[0][0] == 5 and len([x for x in left if x[1].startswith("u0")]) == 1
    assert [x for x in left if x[1][:2] not in ("t0", "u0")] == [(4, "same"), (5, "another lone text"), (6, ""), (6, ""), (9, "a lone text")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 150)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, length):
    seen = defaultdict(int)
    raws = [(t or "").encode() for _, t in rows]
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        left = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((d if d is not None else -1, len(r), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def passages(rng):
    letters = "abcdefgh é"
    text = lambda n: "".join(rng.choices(letters, k=n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 900)]
    rows = [text(rng.randint(0, 700)) for _ in range(40)]
    for _ in range(60):
        p = rng.choice(shared)
        cut = p[rng.randint(0, 5) :] if rng.random() < 0.4 else p
        rows.append(text(rng.randint(0, 300)) + cut + text(rng.randint(0, 300)) + (rng.choice(shared) if rng.random() < 0.3 else ""))
    base = text(1500)
    for _ in range(25):
        b = list(base)
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(1500)] = rng.choice("XYZ")
        rows.append("".join(b))
    rows += [base, base, "ab" * 400, "a" * 150, "a" * 199, "a" * 200, "z" * 201, "q" * 5000, "", " "]
    return list(enumerate(rows)) + [(900, None), (None, base[:300]), (901, base), (901, base)]


@pytest.mark.parametrize("setting", [{}, {"HOT": 2}, {"CHUNK": 700}, {"HOT": 1, "CHUNK": 400, "MERGE_BYTES": 500}])
def test_passages(spark, setting, monkeypatch):
    for k, v in setting.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rows = passages(random.Random(4))
    got = suffix_dedup.remove_repeats(table(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows, 200)


def test_passages_of_templates(spark, monkeypatch):
    """Many texts share long passages around a number that always differs, and many rows are equal."""
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    before, after = word(195), word(230)
    rows = [(i, f"{before}{i:07d}{after}{word(30)}") for i in range(60)] + [(100 + i, before[5:] + word(9)) for i in range(20)] + [(500, before + after)] * 40
    got = suffix_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows, 200)


def test_passages_empty(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_merged_transforms_tell_equal_strings():
    rng = random.Random(3)
    bodies = ["".join(rng.choices("ab", k=rng.randint(200, 420))).encode() for _ in range(6)]
    bodies += [bodies[0][10:310] + b"x", b"y" + bodies[1][:260], bodies[2]]
    shards = [0, 0, 0, 1, 1, 2, 3, 3, 3]
    starts, classes = suffix_dedup.merge_transforms(bodies, shards)
    by_class, by_text = defaultdict(set), defaultdict(set)
    for k, b in enumerate(bodies):
        for i in range(len(b) - 199):
            by_class[classes[starts[k] + i]].add((k, i))
            by_text[b[i : i + 200]].add((k, i))
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, by_text.values()))


@pytest.mark.parametrize("k", [4, 5])
def test_few_words_in_all(spark, k):
    """A chunk that holds fewer words than a shingle."""
    for n in range(k + 2):
        text = " ".join(f"w{i}" for i in range(n)).encode()
        assert [len(s) for s in jaccard_join.shingle_sets([text, b""], k)] == [len(shingles(text.decode(), k)), 0]
    got = jaccard_join.link_documents(table(spark, [(3, "two words"), (4, None)]).coalesce(1), words=k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 1, 3), (4, 0, 4)]
