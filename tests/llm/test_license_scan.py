import pytest

from lodestrata.llm import license_scan
from lodestrata.llm.license_scan import TEMPLATES, PositionalIndex, scan_licenses, words_of

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def brute_force(text):
    words = words_of(text)
    places = sorted((i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == [w.encode() for w in p.split()])
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_words_are_ascii_lowered_runs():
    assert words_of("CC-BY É4\x7fÀ_b") == ["cc".encode(), b"by", "É4".encode(), "À".encode(), b"b"]
    assert words_of(None) == words_of("") == words_of("... --") == []


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = license_scan.query(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_force(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache"}),
        ("the GNU General Public License, version 3", {"gpl", "gnu-gpl"}),
        ("GNU Lesser General Public License", {"gpl", "lgpl"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}),
        ("license license public general", set()),
        ("all rights are reserved", set()),
    ],
)
def test_labels(text, labels):
    index = PositionalIndex(TEMPLATES, {})
    assert {TEMPLATES[k].label for k, _, _ in index.scan(words_of(text))} == labels


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "cc by " * 3, 0), (3, "x " * 50000 + "all rights reserved", 0), (3, "x " * 50000 + "all rights reserved", 0), (4, "cc cc by by", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").withColumnRenamed("n_words", "score")
    got = sorted((r.doc_id or 0, r.n_words, [(m.label, m.start) for m in r.matches if m.base], r.score) for r in scan_licenses(df).collect())
    assert got == [(0, 6, [("cc-by", 0), ("cc-by", 2), ("cc-by", 4)], 1.0), (1, 0, [], 0.0), (2, 0, [], 0.0), (3, 50003, [("reserved", 50000)], 1.0), (3, 50003, [("reserved", 50000)], 1.0), (4, 4, [("cc-by", 1)], 1.0)]
    assert scan_licenses(df.limit(0)).count() == 0


def test_words_elsewhere_take_no_notice_away():
    # As on sf0.1, where 'license' is not among the four rarest words of the notice.
    idf = {w: 9.0 for w in (b"2", b"apache", b"0", b"version")} | {w: 1.0 for w in (b"licensed", b"under", b"the", b"license")}
    index = PositionalIndex(TEMPLATES, idf)
    scan = lambda text: [(TEMPLATES[k].label, s, c) for k, s, c in index.scan(words_of(text))]
    far = " word" * 30
    for text in ("Apache License", "Apache License" + far + " 2 0 version", "version 2 0 0 2" + far + " apache" + far + " Apache License" + far + " licensed under"):
        assert [(label, c) for label, _, c in scan(text)] == [("apache", 2 / 8)]
    assert [label for label, _, _ in scan("apache license" + far + " apache license")] == ["apache"] * 2
    # Rare words all stand outside the key phrase.
    rare = {w: 9.0 for w in (b"licensed", b"under", b"the", b"version")}
    assert [TEMPLATES[k].label for k, _, _ in PositionalIndex(TEMPLATES, rare | {b"apache": 2.0, b"license": 1.0, b"2": 3.0, b"0": 3.0}).scan(words_of("Apache License"))] == ["apache"]


def test_edited_bodies_keep_their_label_and_lose_coverage():
    index = PositionalIndex(TEMPLATES, {})
    for template in license_scan.BODIES:
        k = TEMPLATES.index(template)
        words = words_of(template.words)
        score = lambda own, k=k: max((c for j, _, c in index.scan([b"before"] * 30 + own + [b"after"] * 30) if j == k), default=None)
        key = words_of(template.phrases[0])
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        assert score(words) == 1.0
        # One word in ten is another, but for the phrase: about so much coverage goes.
        changed = [b"other" if i % 10 == 3 and not at <= i < at + len(key) else w for i, w in enumerate(words)]
        lost = sum(a != b for a, b in zip(words, changed, strict=True))
        assert abs(score(changed) - (1 - lost / len(words))) < 0.08
        # Words put in shift what follows; the alignment follows them.
        grown = [x for i, w in enumerate(words) for x in ((b"new", w) if i % 12 == 5 and not at < i < at + len(key) else (w,))]
        assert score(grown) > 0.75
        assert score(words[: at + 1] + words[at + 2 :]) is None
