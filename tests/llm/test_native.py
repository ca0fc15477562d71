import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import line_dedup, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
ROWS = [
    (1, None), (2, ""), (3, " \n\n"), (4, "a b c a b c a b c"), (5, "One line. " * 30), (5, "One line. " * 30), (None, "no id\nno id\n"),
    (7, "x | y | z\n" * 5 + "A sentence " + " ".join(f"w{i}" for i in range(60)) + "."),
    (8, "!! ".join(f"w{i}" for i in range(99))), (9, "\n".join(f"The {w} line of a text without anything odd in it at all {w}." for w in ("first", "second", "third", "fourth", "fifth"))),
    (10, "All rights reserved.\nAll rights reserved."), (11, " ".join(f"w{i % 997}" for i in range(20_000))), (12, "é\x85ü 日本%%\x0bq&"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("_lines", F.lit("x"))


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(i and i + 10_000, t) for i, t in ROWS]
    got = quality.assess(frame(spark, rows)).collect()
    want = sorted((str(i), *slow_counts(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize(
    ("line", "passes"),
    [("Short but closed.", True), ("Home", False), ("a | b | c |", False), ("W" * 60, True), ("Please read our Privacy Policy before you go on, it matters.", False), ("BUY!! NOW!! CHEAP!!", False), ("50%%% of$$$ it***.", False), ("He said: “yes”", True)],
)
def test_line_rules(spark, line, passes):
    assert spark.range(1).select(quality.line_passes(F.lit(line)).alias("p")).first().p is passes


def test_lines_go_first_then_documents(spark):
    got = {r.doc_id: r for r in quality.assess(frame(spark, ROWS).where("doc_id is not null")).collect()}
    assert got[7].n_lines_removed == 5 and got[7].clean_text.startswith("A sentence") and got[7].kept
    assert got[8].kept is False and got[9].n_lines_removed == 0 and got[1].clean_text is None
    assert quality.assess(frame(spark, []).limit(0)).collect() == []


def test_quality_labels(spark):
    medium = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.assess(spark.read.parquet(f"{medium}/documents.parquet")).collect()}
    clean = [got[d] for d, q in labels.items() if q == 1 and got[d].n_words >= 50]
    junk = [got[d] for d, q in labels.items() if q == 0]
    assert all(r.kept for r in clean)
    assert sum(not r.kept for r in junk) >= 0.8 * len(junk)


def test_no_python_in_the_native_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (quality.assess(docs), line_dedup.drop_templates(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def slow_drop(rows, min_docs):
    """The template tree in plain Python: leaf, commonest tokens, agreement, documents."""
    def mask(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in WORD.findall(line))

    docs_of = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if m := mask(line):
                docs_of[m].add(i)
    leaves = defaultdict(list)
    for m in docs_of:
        leaves[len(m), m[:3]].append(m)
    gone = set()
    for ms in leaves.values():
        usual = []
        for j in range(len(ms[0])):
            c = Counter()
            for m in ms:
                c[m[j]] += len(docs_of[m])
            usual.append(max(c.items(), key=lambda x: (x[1], x[0].encode()))[0])
        members = [m for m in ms if sum(a == b for a, b in zip(m, usual)) >= 0.7 * len(m)]
        rest = [m for m in ms if m not in members]
        often = Counter()
        for m in rest:
            for j, t in enumerate(m):
                often[j, t] += len(docs_of[m])
        templates = defaultdict(list, {"usual": members})
        for m in rest:
            fixed = [often[j, t] >= min_docs for j, t in enumerate(m)]
            solid = sum(fixed) >= 0.7 * len(m)
            templates[solid, tuple(t if f or not solid else "<*>" for t, f in zip(m, fixed))].append(m)
        for variants in templates.values():
            if len(set().union(*(docs_of[m] for m in variants))) >= min_docs:
                gone |= set(variants)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n") if t is not None else []
        left = [x for x in lines if mask(x) not in gone]
        out.append((str(i), sum(bool(mask(x)) for x in lines), len(lines) - len(left), None if t is None else "\n".join(left)))
    return sorted(out, key=str)


def test_template_tree_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(i and i + 10_000, t) for i, t in ROWS]
    rows += [(20_000 + i, f"Posted by user{i} on day {i} of the {['big', 'old'][i % 2]} year here\nreal {i} {'text ' * i}") for i in range(20)]
    got = line_dedup.drop_templates(frame(spark, rows).withColumn("n_dropped", F.lit(1))).collect()
    want = slow_drop(rows, line_dedup.MIN_DOCS)
    assert sorted(((str(r.doc_id), r.n_lines, r.n_dropped, r.clean_text) for r in got), key=str) == want
    assert all(r.n_dropped >= 1 for r in got if r.doc_id and r.doc_id >= 20_000)


def test_templates_show_their_fields(spark):
    rows = [(i, f"Posted by user{i} on a {['big', 'old'][i % 2]} and sunny day of a year") for i in range(20)]
    got = line_dedup.templates(frame(spark, rows)).collect()
    assert {r.template for r in got} <= {"Posted by <*> on a big and sunny day of a year", "Posted by <*> on a old and sunny day of a year"} and {r.docs for r in got} == {20}
    assert line_dedup.drop_templates(frame(spark, []).limit(0)).collect() == []


def test_two_templates_in_a_leaf(spark):
    """Both are found, though a word without a digit varies in them and they agree in few positions."""
    names = ["Ada", "Ben", "Cleo", "Dan", "Eve", "Flo", "Gus", "Hal", "Ida", "Jo", "Kim", "Lou"]
    first = [(i, f"Read more about {n} in our weekly letter on gardens and trees") for i, n in enumerate(names)]
    second = [(100 + i, f"Read more about {n} who sells old maps by post since spring") for i, n in enumerate(names[:9])]
    got = line_dedup.drop_templates(frame(spark, first + second + [(500, "Read more about Zoe and this line stands once in all texts")])).collect()
    assert {r.doc_id for r in got if r.n_dropped} == {i for i, _ in first + second}


def test_lines_of_one_document_are_not_recurrent(spark):
    """Twenty similar lines of one document are one document's; eight of different documents recur. Rows without an id count as one."""
    one = "\n".join(f"Chapter one has {w} of the many fine pages" for w in "a b c d e f g h i j k l m n o p q r s t".split())
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_templates(frame(spark, [(1, one), (2, "other text")])).collect()}
    assert got == {1: 0, 2: 0}
    got = line_dedup.drop_templates(frame(spark, [(None, f"The same words {i}\nand own {chr(97 + i)} one") for i in range(12)])).collect()
    assert {r.n_dropped for r in got} == {0}


def test_carriage_returns_are_white_space(spark):
    """The same short sentences, with either line ending, pass the line rules alike."""
    lines = [" ".join(f"{w}{n}" for w in ("some", "words", "that", "end", "here")) + "." for n in range(12)]
    got = quality.assess(frame(spark, [(1, "\n".join(lines)), (2, "\r\n".join(lines) + "\r\n \t\r\n")])).collect()
    assert [r.n_lines_removed for r in sorted(got, key=lambda r: r.doc_id)] == [0, 0] and all(r.kept for r in got)


def test_oracles(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df, sql in ((quality.assess(docs.select("doc_id", "text")).drop("text", "clean_text"), quality.oracle()), (line_dedup.drop_templates(docs.select("doc_id", "text")).drop("text"), line_dedup.oracle())):
        assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(sql).fetchall(), key=str)
