"""Language model and SentencePiece lattice against plain Python."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from weirflow.llm import brown_lm, pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
DOCS = "doc_id long, text string, units string, score int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def languages(rng, n):
    """Texts of two languages: what word follows tells more than how often it is."""
    a, b = [f"a{i}" for i in range(120)], [f"b{i}" for i in range(120)]
    return [(i, " ".join(rng.choices(a if i % 2 else b, k=rng.randint(5, 60)))) for i in range(n)]


def base(rows):
    tokens = {k: (t or "").encode().lower().split() + [None] for k, (_, t) in enumerate(rows)}
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(x for k in tokens if not held[k] for x in tokens[k])
    n, v = sum(c.values()), len(c)
    score = lambda k: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[k])
    return [(held[k], len(tokens[k]), sum(c[x] > 0 for x in tokens[k]), n, score(k)) for k in tokens]


@pytest.mark.parametrize("limit", [{}, {"COUNTED": 90, "HEAD": 40}, {"COUNTED": 1 << 20, "HEAD": 40}])
def test_brown(spark, limit, monkeypatch):
    """Counts against plain Python, and scores against the model that the operator made, computed word by word."""
    for k, v in limit.items():
        monkeypatch.setattr(brown_lm, k, v)
    made = {}
    for name in ("cluster", "_classed", "_matrix"):
        real = getattr(brown_lm, name)
        monkeypatch.setattr(brown_lm, name, lambda *a, real=real, name=name: made.setdefault(name, real(*a)))
    tails = []
    real_assign = brown_lm.assign
    monkeypatch.setattr(brown_lm, "assign", lambda *a: tails.append(df := real_assign(*a)) or df)
    real_unstage = brown_lm.unstage
    monkeypatch.setattr(brown_lm, "unstage", lambda *t: None)
    rows = languages(random.Random(1), 400) + [(1000, None), (1001, ""), (1002, "A a1 B1 unseen é"), (None, "a1 a2"), (5, "a1 a2"), (5, "a1 a2"), (1003, "a1 " * 20_000), (1004, "rare1 a1 rare2 rare2 b3"), (1010, "rare1 nowhere")]
    got = brown_lm.score(table(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0], r[1], r[2], r[3], round(r[4], 4))
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(map(key, base(rows)))
    classes, _, told = made["cluster"]
    assert told == sorted(told) and len(told) > 1  # each round raised the likelihood

    # classes by word: the head by rank, other training words from the table, unseen ones by spelling
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    order = sorted(c, key=lambda w: (-c[w], brown_lm.word_key(w)))
    head = {w: int(classes[1 + i]) for i, w in enumerate(order[: min(brown_lm.HEAD, brown_lm.COUNTED)])}
    table_rows = {r["key"]: r for r in tails[0].collect()}
    signed = lambda w: int(np.uint64(brown_lm.word_key(w)).astype(np.int64))
    assert set(table_rows) == {signed(w) for w in c if w not in head}
    assert all(table_rows[signed(w)]["n"] == c[w] for w in c if w not in head)
    shape_class = lambda w: int(classes[brown_lm.HEAD + 1 + brown_lm.shape(w)])
    own = lambda w: head[w] if w in head else table_rows[signed(w)]["class"] if w in c else shape_class(w)
    pairs, members = Counter(), Counter(own(w) for w in c)
    for s in range(brown_lm.SHAPES):
        members[int(classes[brown_lm.HEAD + 1 + s])] += 1
    members[0] = 1
    paths = [[0, *map(own, ws), 0] for ws in tokens]
    for p, h in zip(paths, held, strict=True):
        pairs.update(zip(p, p[1:], strict=False) if not h else ())
    assert made["_matrix"].tolist() == [[pairs[i, j] for j in range(brown_lm.CLASSES)] for i in range(brown_lm.CLASSES)]
    left, right = Counter(), Counter()
    for (i, j), n in pairs.items():
        left[i] += n
        right[j] += n
    n_docs = held.count(False)

    def score(p, ws):
        total = 0.0
        for i, j, n in zip(p, p[1:], [c[w] for w in ws] + [n_docs], strict=False):
            total += math.log10((pairs[i, j] + 0.1) / (left[i] + 0.1 * brown_lm.CLASSES)) + math.log10((n + 0.1) / (right[j] + 0.1 * members[j]))
        return total

    want = sorted((len(ws) + 1, round(score(p, ws), 3)) for p, ws in zip(paths, tokens, strict=True))
    have = sorted((r.n_tokens, round(r.score, 3)) for r in got)
    assert [n for n, _ in have] == [n for n, _ in want] and [x for _, x in have] == pytest.approx([x for _, x in want], abs=2e-3, rel=1e-6)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)
    out = [r for r in got if r.held_out and r.n_tokens > 3]
    if not limit:
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    real_unstage(*tails)


def test_brown_counts_that_fit(spark):
    counts = spark.createDataFrame([(i, 1000) for i in range(20)] + [(100 + i, 2) for i in range(10)] + [(200 + i, 1) for i in range(30)], "key long, n long")
    for room, want, cut in ((60, 60, 1), (59, 30, 2), (30, 30, 2), (29, 20, 512), (19, 0, 1024)):
        keys, n, got = brown_lm.most_frequent(counts, room)
        assert len(keys) == want and n.tolist() == sorted(n, reverse=True) and got == cut


def test_brown_all_held_out(spark):
    """Without training documents every count is 0 and scores are finite."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = brown_lm.score(table(spark, [(i, "a b c") for i in ids])).collect()
    assert len(got) == len(ids) and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_brown_is_a_distribution(spark, monkeypatch):
    """The classes' transitions sum to one, and so do each class's words with its unseen ones."""
    seen = {}
    real = brown_lm._matrix
    monkeypatch.setattr(brown_lm, "_matrix", lambda *a: seen.setdefault("m", real(*a)))
    rows = languages(random.Random(2), 60)
    brown_lm.score(table(spark, rows)).collect()
    m = seen["m"]
    assert m.sum() == base(rows)[0][3]
    p = (m + 0.1) / (m.sum(1, keepdims=True) + 0.1 * brown_lm.CLASSES)
    assert np.allclose(p.sum(1), 1)


def test_brown_empty(spark):
    assert brown_lm.score(table(spark, [])).count() == 0


def test_exchange_gains():
    """Two groups of units that only follow themselves end in different classes."""
    after = np.zeros((4, 3), np.int64)
    after[0, 1] = after[1, 2] = 50
    matrix = np.array([[0, 0, 0], [0, 1000, 50], [0, 50, 1000]])
    new = brown_lm.best_classes(after, after, np.array([2, 1, 1, 2]), matrix)
    assert new.tolist() == [1, 2, 1, 2]


PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def every_path(m, s):
    """All segmentations of a segment by score."""
    if not s:
        return [(0.0, [])]
    out = []
    for end in range(1, min(len(s), m.longest) + 1):
        p = s[:end]
        if p in m.score:
            head = (m.score[p], [m.id[p]])
        elif end == 1:
            head = (m.unknown, m._unknown_ids(p))
        else:
            continue
        out += [(head[0] + x, head[1] + ids) for x, ids in every_path(m, s[end:])]
    return sorted(out, key=lambda t: -t[0])


WORDS = ["▁the", "▁", "▁▁▁", "▁ingre", "▁été", "\n", "▁a😀b", "x", "▁émenta", "日本", "▁▁x", "▁réeaux,"]


@pytest.mark.parametrize("s", WORDS)
def test_lattice(model, s):
    want = every_path(model, s)
    got = model.n_best(s, 4)
    assert [x for x, _ in got] == pytest.approx([x for x, _ in want[:4]])
    for x, ids in got:
        assert any(ids == i and x == pytest.approx(y) for y, i in want)
    ((best, ids, loss),) = model.best_batch([s])
    assert best == pytest.approx(want[0][0]) and any(ids == i and best == pytest.approx(y) for y, i in want)
    assert loss == (pytest.approx(want[0][0] - want[1][0]) if len(want) > 1 else np.inf)


def test_best_of_many(model, monkeypatch):
    """Segments of all lengths at once, some with characters without a piece, against the search one by one;
    windows that are no piece are told without a search for nearly all."""
    rng = random.Random(7)
    words = ["▁" + "".join(rng.choices("etaoinshrdlué日😀\x01", weights=[9] * 13 + [1] * 3, k=rng.randint(0, 20))) for _ in range(2000)]
    asked, real = [], np.searchsorted
    monkeypatch.setattr(pieces.np, "searchsorted", lambda a, v, *more: (asked.append(np.size(v)), real(a, v, *more))[1])
    got = model.best_batch(words)
    windows = sum(len(w) * (len(w) + 1) // 2 for w in words)
    assert sum(asked) * 3 < windows
    for w, (best, ids, loss) in zip(words[:300], got[:300], strict=True):
        two = model.n_best(w, 2)
        assert best == pytest.approx(two[0][0]) and model.decode(ids) == model.decode(two[0][1])
        assert loss == (pytest.approx(two[0][0] - two[1][0]) if len(two) > 1 else np.inf)


def test_text_n_best(model):
    enc = pieces.Encoder(PATH, 5)
    for text in ("the cat", "in in in", "a\nb", "été réa", "x"):
        segs = model.segments(text)
        want = sorted((sum(x for x, _ in c), [i for _, ids in c for i in ids]) for c in itertools.product(*[every_path(model, s) for s in segs]))[::-1]
        ((best, score, nexts, placed),) = enc.encode([text])
        assert score == pytest.approx(want[0][0])
        assert [score - x for x, _ in nexts] == pytest.approx([x for x, _ in want[:5]])
        for (x, swaps), put in zip(nexts, placed, strict=True):
            assert pieces.spelled(best, put).tolist() == enc.swapped(text, swaps)
            assert any(enc.swapped(text, swaps) == ids and score - x == pytest.approx(y) for y, ids in want)
        assert model.decode(best.tolist()) == text


def test_encode_table(spark):
    texts = [None, "", " ", "  two  blanks ", "line\nbreak\ttab", "été 日本 😀́", "▁", "w" * 300, "word " * 20_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "null id")]
    got = pieces.encode(table(spark, rows), PATH, with_ids=True, with_model=True)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.round_trip == (r.doc_id != 6) and r.n_pieces == len(r.ids) and r.losses[0] == 0 and r.losses == sorted(r.losses)
        assert r.n_found == len(r.losses) <= pieces.N_BEST
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in out:
        if r.doc_id is not None:
            own = library.encode(texts[r.doc_id] or "")
            assert (r.model_pieces, r.model_crc32) == (len(own), zlib.crc32(np.array(own, "<u4")))
    every = {}
    for r in pieces.segmentations(got).collect():
        every.setdefault(r.doc_id, []).append((r["rank"], r.loss, r.ids))
    for r in out:
        if r.doc_id not in (3, None):
            mine = sorted(every[r.doc_id])
            assert [x for _, x, _ in mine] == r.losses and mine[0][2] == r.ids
            assert [zlib.crc32(np.array(ids, "<u4")) for _, _, ids in mine[1:]] == r.next_crc32
            assert len({tuple(ids) for _, _, ids in mine}) == len(mine)
    back = {r.doc_id: r.text for r in pieces.decode(got, PATH).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i not in (6, None))
    assert pieces.encode(table(spark, []), PATH).count() == 0
