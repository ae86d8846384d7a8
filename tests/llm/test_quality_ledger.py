import re

from callboard.llm import quality_ledger as ledger

from frames import empty_documents, multiset, odd_documents, texts_of


def brute(raw):
    text = raw.decode()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = {}
    for window in windows:
        found[window] = found.get(window, 0) + 1
    covered = {i + j for i, window in enumerate(windows) if found[window] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), text.count("\n") + 1, dup, len(covered))


REPEATS = [
    (20, "a a a a a a", "en", "a", 1),
    (21, "x y z u v w x y z u v\nsame line\nsame line\r\nsame line\n\n\n same line", "en", "a", 1),
    (22, "#*$%&|<> " * 30, "en", "a", 1),
    (23, "wort " * 4, "de", "a", 1),
    (24, "a b c d e", "en", "a", 1),
    (24, "a b c d e", "en", "a", 1),
]


def test_measures_against_brute_force(spark):
    df = odd_documents(spark, REPEATS)
    got = [tuple(r) for r in ledger.measured(df, keep=["doc_id"]).collect()]
    assert multiset(got) == multiset((doc_id, *brute(text)) for doc_id, text in texts_of(df))


def test_bits_policies_and_verdicts(spark):
    rows = {r.doc_id: r for r in ledger.judged(odd_documents(spark, REPEATS), keep=["doc_id"]).collect()}
    assert rows[2].base_failed and not rows[2].kept and rows[2].failed == 1
    assert not rows[1].base_failed and rows[1].kept and rows[1].failed == 0
    assert rows[21].failed & 2 == 2
    for row in rows.values():
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
        assert not (row.base_failed and row.kept)


def test_ablations_match_rows(spark):
    entries = ledger.ledger(ledger.measured(odd_documents(spark, REPEATS)))
    bits = [r.failed for r in entries.collect()]
    names = [rule.name for rule in ledger.RULES]
    for row in ledger.ablations(entries).collect():
        policy = next(p for p in ledger.POLICIES if p.version == row.version)
        counted, bit = ledger.mask(policy), 1 << names.index(row.rule)
        assert row.n_rows == len(bits)
        assert row.n_failed == sum(bool(b & bit) for b in bits)
        assert row.n_failed_alone == sum(b & counted == bit for b in bits)
        assert row.n_kept == sum(b & counted == 0 for b in bits)


def test_empty_table_and_clashing_columns(spark):
    assert ledger.judged(empty_documents(spark), keep=["doc_id"]).collect() == []
    df = odd_documents(spark).selectExpr("*", "'x' AS N_words", "7 AS failed")
    assert ledger.ledger(ledger.measured(df)).where("doc_id = 1").first().n_words == 12
