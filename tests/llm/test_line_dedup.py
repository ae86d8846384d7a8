import hashlib
import random

from callboard.llm import line_dedup

from frames import empty_documents, multiset, odd_documents, texts_of


def brute(documents):
    return [(doc, n, removed, hashlib.sha256(left).hexdigest()) for doc, n, removed, left in brute_texts(documents)]


def brute_texts(documents, size=3, long_line=50):
    """(doc, lines, lines removed, text left): every window that stands earlier too goes, by comparing lines themselves."""
    places = []
    for doc, raw in documents:
        lines = raw.split(b"\n")
        full = [i for i, line in enumerate(lines) if line.split()]
        for a in range(len(full) - size + 1):
            covers = full[a : a + size]
            places.append((doc, covers[0], tuple(lines[i] for i in covers), covers))
        # A single long line, or two neighbours that are long together.
        count = {i: len(lines[i].split()) for i in full}
        places += [(doc, i, (lines[i],), [i]) for i in full if count[i] >= long_line]
        for i, j in zip(full, full[1:]):
            if count[i] < long_line <= count[i] + count[j]:
                places.append((doc, i, (lines[i], lines[j]), [i, j]))
    first = {}
    for doc, line, content, _ in sorted(places, key=lambda p: p[:2]):
        first.setdefault(content, (doc, line))
    gone = {(doc, i) for doc, line, content, covers in places if first[content] < (doc, line) for i in covers}
    out = []
    for doc, raw in documents:
        lines = raw.split(b"\n")
        left = b"\n".join(line for i, line in enumerate(lines) if (doc, i) not in gone)
        out.append((doc, len(lines) if raw else 0, sum((doc, i) in gone for i in range(len(lines))), left))
    return out


def corpus():
    random.seed(11)
    pool = ["half " * 30, "other half " * 14] + [f"line number {i} of the pool" for i in range(12)] + ["", " \t", "word " * 60, "other " * 50]
    texts = ["\n".join(random.choices(pool, k=random.choice([1, 2, 3, 6, 15]))) for _ in range(60)]
    texts += ["a\nb\nc\nd", "x\nb\nc\nd\ny", "a\n\nb\n\n\nc", "a\na\na\na\na\na", "only\ntwo", "only\ntwo"]
    return [(100 + i, text, "en", "s", 1) for i, text in enumerate(texts)]


def test_against_brute_force(spark):
    df = odd_documents(spark, corpus()).where("doc_id NOT IN (6, 7)")
    got = multiset(map(tuple, line_dedup.digests(df.where("doc_id is not null")).collect()))
    assert got == multiset(brute(texts_of(df.where("doc_id is not null"))))


def test_repeated_ids_and_nulls(spark):
    text = "first line here\nsecond line here\nthird line here"
    rows = [(9, text, "en", "s", 1), (9, text, "en", "s", 1), (None, text, "en", "s", 1), (3, f"x\n{text}", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = multiset((r.doc_id, r.n_removed) for r in line_dedup.digests(df).collect())
    assert found == multiset([(None, 0), (3, 3), (9, 3), (9, 3)])


def test_columns_stay_and_clashing_ones_are_replaced(spark):
    df = odd_documents(spark, corpus()).selectExpr("*", "1 AS doc", "2 AS print", "3 AS later", "4 AS N_lines")
    found = line_dedup.deduplicated(df)
    assert set(found.columns) == (set(df.columns) - {"N_lines"}) | {"n_lines", "n_removed"}
    assert found.count() == df.count()
    null = found.where("doc_id = 2").first()
    assert null.text is None and (null.n_lines, null.n_removed, null.later) == (0, 0, 3)
    assert line_dedup.without_repeats(df.drop("N_lines")).columns == df.drop("N_lines").columns


def test_emptied_texts_go(spark):
    text = "\n".join(f"line {i} of a text" for i in range(5))
    rows = [(1, text, "en", "s", 1), (2, text + "\n ", "en", "s", 1), (3, "", "en", "s", 1), (4, " ", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in line_dedup.without_repeats(df).collect()) == [1, 3, 4]


def test_empty_table(spark):
    assert line_dedup.digests(empty_documents(spark)).collect() == []


def test_passages_on_two_lines_go(spark):
    """Passages of 50 words or more on two lines; those of fewer words stay."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, c = words("a", 23), words("b", 46), words("c", 26)
    texts = [
        (1, f"{a}\n{b}"), (2, f"{a}\n\n{b}"), (3, f"own line\n{a}\n{b}\nanother"), (4, f"{a}\n{c}"), (5, f"{a}\nx\n{b}"), (6, f"{a}\n{c}"),
        (7, f"short one\n{words('d', 60)}"), (8, f"short one\n{words('d', 60)}"),
    ]
    rows = [(doc, text, "en", "s", 1) for doc, text in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = multiset(map(tuple, line_dedup.digests(df).collect()))
    assert got == multiset(brute([(doc, text.encode()) for doc, text in texts]))
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    stay = {doc: text for doc, text in texts if doc in (1, 4, 5, 6, 7)}
    assert kept == stay | {3: "own line\nanother"}


def test_every_repeated_window_is_found_by_its_fingerprint():
    """Windows of a text are all attached to selected lines, equal windows at equal places."""
    random.seed(5)
    lines = [f"l{random.randrange(40)} " * random.choice([1, 1, 20, 30, 60]) for _ in range(300)]
    text = "\n".join(lines).encode()
    found = list(line_dedup.positions(text))
    windows = [(first, n, h, at - first, print_) for at, print_, chosen in found for first, n, h in chosen]
    assert sum(n == 3 for _, n, *_ in windows) == 298 and len(found) < 0.8 * len(lines)
    by_content = {}
    for first, n, h, offset, print_ in windows:
        assert 0 <= offset < n
        by_content.setdefault(tuple(lines[first : first + n]), set()).add((h, offset, print_))
    assert all(len(same) == 1 for same in by_content.values())


def test_a_line_of_very_many_documents(spark):
    """Also where adaptive execution divides the joins on its fingerprints and windows."""
    common = "the same line here\nand the same below\nand a third one"
    rows = [(i, f"{common}\nown line {i}\nown too {i}", "en", "s", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = line_dedup.deduplicated(df).cache()
        assert out.where("n_removed = 3").count() == 2999 and out.where("n_removed = 0").count() == 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
