import hashlib
import random
import re

from callboard.llm import decontamination

from frames import empty_documents, multiset, odd_documents, texts_of


def split(raw):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), raw.decode())
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(documents, items, size=10):
    strings = {}
    for item, raw in items:
        found = split(raw)
        for i in range(max(1, len(found) - size + 1) if found else 0):
            strings.setdefault(tuple(found[i : i + size]), set()).add(item)
    out = []
    for doc_id, raw in documents:
        found = split(raw)
        hit, names = set(), set()
        for i in range(len(found)):
            for length in {len(s) for s in strings}:
                if (own := strings.get(tuple(found[i : i + length]))) and i + length <= len(found):
                    hit |= set(range(i, i + length))
                    names |= own
        ids = ",".join(sorted(str(x) for x in names if x is not None))
        out.append((doc_id, len(found), len(hit), len(names - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, extra string")


ITEMS = [
    (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu", "x"),
    (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda nu", "x"),
    (10, "ünï", "x"),
    (11, "short item of five words", "x"),
    (12, None, "x"),
    (13, "", "x"),
    (14, "...", "x"),
    (None, "nobody owns this", "x"),
    (1, "second part of the first item here it is really", "x"),
]


def texts():
    random.seed(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu ünï short item of five words nobody owns this".split()
    exact = ["ALPHA beta-gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "x ünï. y", "nobody owns this", "shorter item of five words"]
    exact += ["Short item of five words and short item of five words", "second part of the first item here it is really"]
    return exact + [" ".join(random.choices(words, k=random.choice([1, 5, 40, 200]))) for _ in range(120)]


def test_against_brute_force(spark):
    more = [(100 + i, text, "en", "a", 1) for i, text in enumerate(texts())]
    df = odd_documents(spark, more)
    got = decontamination.report(df, benchmark(spark, ITEMS), ["doc_id"]).collect()
    items = [(a, (b or "").encode()) for a, b, _ in ITEMS]
    assert multiset(map(tuple, got)) == multiset(brute(texts_of(df), items))


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    df = odd_documents(spark, [(100 + i, text, "en", "a", 1) for i, text in enumerate(texts())])
    whole = decontamination.report(df, benchmark(spark, ITEMS), ["doc_id"]).collect()
    monkeypatch.setattr(decontamination, "BLOCK_TEXT", 60)
    assert multiset(decontamination.report(df, benchmark(spark, ITEMS), ["doc_id"]).collect()) == multiset(whole)


def test_long_and_repeated_items_are_cut(spark, monkeypatch):
    df = odd_documents(spark, [(100 + i, text, "en", "a", 1) for i, text in enumerate(texts())])
    monkeypatch.setattr(decontamination, "PART", 3)
    monkeypatch.setattr(decontamination, "BLOCK_TEXT", 12_000)
    items = [(20, " ".join(texts()[20:40]), "x"), (21, texts()[-1], "x"), *ITEMS]
    got = decontamination.report(df, benchmark(spark, items * 30), ["doc_id"]).collect()
    assert multiset(map(tuple, got)) == multiset(brute(texts_of(df), [(a, (b or "").encode()) for a, b, _ in items]))
    blocks = list(decontamination._blocks(benchmark(spark, items * 30), "item_id", "text", 10))
    assert len(blocks) > 1 and len({part for block in blocks for part in block}) == sum(map(len, blocks))
    assert max(len(decontamination.windows(text)) for block in blocks for _, text in block) <= 3


def test_shift_table_finds_overlapping_strings():
    strings = [b" a b c d e f g ", b" b c d e f g h ", b" a b c d e f g h "]
    table = decontamination.ShiftTable(strings)
    found = sorted(table.search(b" x a b c d e f g h a b c d e f g "))
    assert found == [(2, strings[0]), (2, strings[2]), (4, strings[1]), (18, strings[0])]


def test_empty_tables_and_clashing_columns(spark):
    assert decontamination.report(empty_documents(spark), benchmark(spark, ITEMS), ["doc_id"]).collect() == []
    df = odd_documents(spark).selectExpr("*", "'s' AS Spans", "'i' AS items", "1 AS n_hit")
    rows = decontamination.report(df, benchmark(spark, []), ["doc_id"]).collect()
    assert len(rows) == df.count() and not any(r.contaminated for r in rows)


def test_clean_keeps_other_rows_as_they_are(spark):
    df = odd_documents(spark, [(100, "xx short item of five words yy", "en", "a", 1)])
    kept = decontamination.clean(df, benchmark(spark, ITEMS))
    assert kept.columns == df.columns and multiset(kept.collect()) == multiset(df.where("doc_id IS NULL OR doc_id <> 100").collect())
