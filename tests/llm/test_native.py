"""Quality rules, mixing, exact dedup and licences on small cases, against plain Python."""

import hashlib
import re
import textwrap
from collections import Counter

import pytest

from weirflow.llm import exact_dedup, licenses, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, row string, sha string"


def table(spark, rows):
    """(doc_id, text, source) rows with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1, "r", "s") for i, t, s in rows], DOCS)


PROSE = " ".join(f"word{i} and{i} more{i}." for i in range(40))


def counts(text):
    t = text or ""
    words = t.encode().split()
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + o for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    texts = [None, "", " \t\n", "a", "a b c a b c a b", "x\nx\n\nx \n|#", PROSE, PROSE + "\n" + PROSE, "é " * 60, "a\x0bb\x0cc\x1cd e", "w " * 30_000 + "é€😀."]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(6, PROSE, "s")]
    got = quality.judge(table(spark, rows)).selectExpr("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(r.text)
        assert tuple(r)[2:7] == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    by = {r.doc_id: r.kept for r in got}
    assert by[6] and not by[7] and not by[0]


def test_quality_lines(spark):
    menu = "Home | News | Sport | Weather | Travel | About | Contact | Login"
    text = f"{PROSE}\n{menu}\nPlease accept cookies to go on.\n{'no end in sight ' * 10}\nShort title\n" + "##**$$ %% ok"
    docs = table(spark, [(1, text, "s"), (2, "\n".join([menu] * 9 + [PROSE[:400]]), "s"), (3, None, None)])
    got = quality.clean_documents(docs)
    assert got.columns == docs.columns
    (only,) = got.collect()
    assert only.doc_id == 1 and only.text == f"{PROSE}\nShort title" and only.n_chars == len(only.text) and only["kept"] == "k"


def test_quality_keeps_wrapped_prose_and_drops_furniture(spark):
    """Prose that is wrapped at a column has lines without a mark; in any language furniture goes."""
    words = " ".join(f"word{i} and{i}" + ("." if i % 40 == 39 else "") for i in range(120))
    wrapped = "\n".join(textwrap.wrap(words, 78))
    assert sum("." not in x for x in wrapped.split("\n")) > 15
    lines = ["Alle Rechte vorbehalten.", "Lea nuestra POLÍTICA DE PRIVACIDAD aquí.", "Tous droits réservés.", "Please read more."]
    (got,) = quality.clean_documents(table(spark, [(1, "\n".join([wrapped, *lines]), "s")])).collect()
    assert got.text == wrapped


def test_quality_empty(spark):
    assert quality.judge(table(spark, [])).count() == 0
    assert quality.clean_documents(table(spark, [])).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        t = {s: w[s] * rest / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] >= most * sizes[s]}
        if not over:
            return t | {s: float(most * sizes[s]) for s in capped}
        capped |= over
        if len(capped) == len(order):
            return {s: float(most * sizes[s]) for s in order}


@pytest.mark.parametrize("per_source", [{"a": 40, "b": 40, None: 40}, {"a": 3, "b": 200, "c": 60, "d": 1}, {"z": 500, "é": 5}])
def test_mix(spark, per_source):
    rows, i = [], 0
    for s, n in per_source.items():
        for k in range(n):
            rows.append((i, "w " * (1 + (k * 7) % 23), s))
            i += 1
    rows += [(i, None, "a"), (i + 1, "", None), (0, rows[0][1], rows[0][2])]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]  # one id is there twice and goes as one
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, got))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())


def test_mix_empty(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix_documents(table(spark, [(1, None, "a"), (2, " ", None)])).count() == 0


def test_exact_dedup(spark):
    rows = [(i, f"text {i % 50}", "s") for i in range(300)] + [(1000 + i, f"only {i}", None) for i in range(500)]
    rows += [(2000, None, "s"), (2001, "", "s"), (None, "text 1", "s"), (None, "lone", "s"), (299, "text 49", "t"), (5000, "L" * 200_000, "s"), (5001, "L" * 200_000, "s")]
    docs = table(spark, rows)
    got = exact_dedup.resolve(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    stays = Counter()
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g)
        assert r.keep_id == max((i for i in g if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        stays[r.text_sha256] += r.kept
    assert set(stays.values()) == {1}
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(dict.fromkeys({t or "" for _, t, _ in rows}, 1))


def test_exact_dedup_in_slices(spark, monkeypatch):
    """More rows than a filter holds are tested slice by slice; equal rows and ids end alike."""
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 1 << 12)
    docs = table(spark, [(i, f"t{i % 700}", "s") for i in range(1000)] + [(3, "t3", "s"), (None, "t5", "s"), (999, "t299", "s")])
    rows = exact_dedup._hashed(docs, "doc_id", "text")
    tested, filters = exact_dedup.flagged(rows, 1003)
    assert len(filters) > 3 and tested.count() == 1003
    got = exact_dedup.resolve(docs)
    assert got.where("kept").count() == 700
    left = exact_dedup.drop_copies(docs)
    assert sorted(r.text for r in left.collect()) == sorted(f"t{i}" for i in range(700))


def test_exact_dedup_hot_and_empty(spark):
    docs = table(spark, [(i, "same" if i % 3 == 0 else f"t{i}", "s") for i in range(6000)])
    got = exact_dedup.resolve(docs)
    assert got.where("kept").count() == 4001 and got.where("group_size = 2000").count() == 2000
    assert exact_dedup.resolve(table(spark, [])).count() == 0
    assert exact_dedup.drop_copies(table(spark, [])).count() == 0


def test_licenses(spark):
    mit = " ".join(s.capitalize() + "." for k, s in licenses.SENTENCES.items() if k in ("mit-grant", "mit-notice", "mit-as-is"))
    rows = [
        (1, "Prose.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "s"), (2, "The licence of the poet.", "s"), (3, None, "s"), (4, "", "s"),
        (5, f"Intro. {mit} The end.", "s"), (6, "licensed UNDER the apache license, version 2.0!\nReleased under the MIT License.", "s"), (6, "licensed UNDER the apache license, version 2.0!\nReleased under the MIT License.", "s"),
        (7, "x " * 100_000 + ". Released under the MIT License.", "s"),
    ]
    got = {}
    for r in licenses.scan(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.rules, r.licenses, r.n_matches))
    assert got == {
        1: [("cc-by-nc-4.0-reference,mit-reference", "CC-BY-NC-4.0,MIT", 2)], 5: [("mit-text", "MIT", 1)],
        6: [("apache-2.0-reference,mit-reference", "Apache-2.0,MIT", 2)] * 2, 7: [("mit-reference", "MIT", 1)],
    }
    assert licenses.scan(table(spark, [])).count() == 0


def test_licenses_of_both_cuts_and_other_tables(spark):
    """One-line references beside a wrapped text are all found; a table of one's own has its own hint."""
    mit = licenses.STANDARD["mit-text"][0]
    rows = [(1, "Released under the MIT License.\nLicensed under CC BY 4.0.\n\n" + mit, "s"), (2, "Bees may be kept by anyone.\nDrones, too.", "s")]
    got = {r.doc_id: r.rules for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {1: "cc-by-4.0-reference,mit-reference,mit-text"}
    own = licenses.scan(table(spark, rows), sentences={"bees": "bees may be kept by anyone", "drones": "drones too"}, rules={"hive": ("BEE-1", ["bees", "drones"])}, standard={})
    assert [(r.doc_id, r.rules, r.licenses) for r in own.collect()] == [(2, "hive", "BEE-1")]
    known = list(licenses.table_of())
    assert all(re.search(licenses.hint(known), s) for s in known)


def test_licenses_standard_texts(spark):
    """Literal texts, as files carry them: wrapped, one paragraph a line, or indented."""
    texts = {k: t for k, (t, _) in licenses.STANDARD.items()}
    mit, apache, gpl, bsd = (texts[k] for k in ("mit-text", "apache-2.0-header", "gpl-3.0-notice", "bsd-3-clause-text"))
    rows = [
        (1, "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + mit, "s"), (2, "Copyright 2020 A B\n\n" + apache, "s"), (3, "    " + gpl.replace("\n", "\n    "), "s"),
        (4, gpl.replace("software:", "software;"), "s"), (5, mit.replace("\n\n", "@").replace("\n", " ").replace("@", "\n"), "s"), (6, bsd, "s"), (7, mit + "\n" + mit, "s"),
        (8, apache.replace("at\n\n    http", "at http"), "s"), (9, mit[: mit.index("copies of the Software, and")], "s"), (10, "Released under the MIT License\nand more.\n\n" + apache, "s"),
    ]
    got = {r.doc_id: (r.rules, r.licenses, r.n_matches) for r in licenses.scan(table(spark, rows)).collect()}
    header = "apache-2.0-header,apache-2.0-reference"
    assert got == {
        1: ("mit-text", "MIT", 1), 2: (header, "Apache-2.0", 2), 3: ("gpl-3.0-notice", "GPL-3.0", 1), 4: ("gpl-3.0-notice", "GPL-3.0", 1), 5: ("mit-text", "MIT", 1),
        6: ("bsd-2-clause-text,bsd-3-clause-text", "BSD-2-Clause,BSD-3-Clause", 2), 7: ("mit-text", "MIT", 2), 8: (header, "Apache-2.0", 2),
        10: (f"{header},mit-reference", "Apache-2.0,MIT", 3),
    }
