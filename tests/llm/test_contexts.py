"""Contexts of one to three words on both sides find identifiers that no fixed pattern has."""

from pyspark.sql import functions as F

from loggrove.llm import pii


def found(spark, rows):
    texts = dict(rows)
    return {r.doc_id: {texts[r.doc_id][x.start : x.end] for x in r.found if x.kind == "context"} for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_two_words_before_and_one_after(spark):
    filler = "you may meet at noon. look at me. "
    rows = [(i, f"{filler}reach me at user{i}@mail.com or come") for i in range(30)]  # two words tell, 'at' alone doesn't
    rows += [(100 + i, f"{filler}reach me at usr-{1000 + 7 * i}-x or come") for i in range(10)]
    rows += [(200 + i, f"{filler}+1 555 010 {1000 + i} is-my-line now") for i in range(30)] + [(300 + i, f"{filler}{70000 + i} is-my-line now") for i in range(10)]
    rows += [(400 + i, f"{filler}in the year {1900 + i} at noon") for i in range(30)]
    got = found(spark, rows)
    assert all(got[100 + i] == {f"usr-{1000 + 7 * i}-x"} and got[300 + i] == {str(70000 + i)} for i in range(10))
    assert not any(v for k, v in got.items() if not (100 <= k < 110 or 300 <= k < 310))


def test_labels_with_separators(spark):
    rows = [(i, f"name=x memberid:m{i}@b.org; rest") for i in range(20)] + [(100 + i, f"memberid={4000 + i}-q rest") for i in range(5)]
    got = found(spark, rows)
    assert all(got[100 + i] == {f"{4000 + i}-q"} for i in range(5)) and not any(got[i] for i in range(20))


def test_both_ways_of_counting(spark, monkeypatch):
    texts = spark.createDataFrame([("a b c a b: 12 B",), ("a=b",), ("",)], "text string")
    words = [pii.gram(*map(F.lit, w)) for w in (["a"], ["b"], ["a", "b"], ["b", "c", "a"], ["c", "c"], ["b", "00", "b"])]
    wanted = spark.range(1).select(F.explode(F.array(*words)).alias("t"))
    few = {r.t: r.total for r in pii.totals(texts, wanted).collect()}
    monkeypatch.setattr(pii, "FEW_PATTERNS", 0)
    assert {r.t: r.total for r in pii.totals(texts, wanted).collect()} == few and sorted(few.values()) == [1, 1, 3, 3, 4]


def test_planted_identifiers_inside_documents(spark):
    """Unseen identifiers in whole documents, behind contexts that mail addresses teach: recall and precision."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    n = F.col("doc_id").cast("string")
    own = F.concat(F.lit("zq-"), F.substring(F.translate(F.sha2(n, 256), "abcdef", "123456"), 1, 7), F.lit("-k"))
    lead = F.element_at(F.array(*[F.lit(x) for x in ("\nyou can write me at ", "\nmitgliedsnummer: ", " the ledger says ")]), (F.col("doc_id") % 3 + 1).cast("int"))
    mail = F.concat(F.lit("p"), n, F.lit("@mail.example"))
    kind = F.floor(F.col("doc_id") / 3) % 4
    put = F.concat(lead, F.when(kind == 0, own).otherwise(mail), F.lit("\n"))
    put = F.when(kind == 3, F.concat(F.lit("\nparcel "), own, F.lit("\n"))).otherwise(put)  # the same identifiers, without such a context
    blank = F.expr("locate(' ', text, cast(length(text) / 2 as int))")  # between words: a torn word would be a context that only mails have
    half = F.when(blank > 0, blank).otherwise(F.length("text")).cast("int")
    planted = docs.select("doc_id", F.concat(F.substring(F.col("text"), F.lit(1), half), put, F.substring(F.col("text"), half + 1, F.length("text"))).alias("text"), own.alias("own"), kind.alias("kind"))
    want, errors = {r.doc_id: r for r in planted.collect()}, []
    hit = wrong = 0
    for r in pii.extract(planted).collect():
        row = want[r.doc_id]
        new = [row.text[x.start : x.end] for x in r.found if x.kind == "context"]
        hit += row.kind == 0 and row.own in new
        wrong += len([x for x in new if x != row.own or row.kind == 3])
        errors += [(row.kind, row.text[max(0, x.start - 40) : x.end + 20]) for x in r.found if x.kind == "context" and (row.kind == 3 or row.text[x.start : x.end] != row.own)]
    n = sum(r.kind == 0 for r in want.values())
    print(errors)
    print("identifiers planted", n, "found", hit, "wrong", wrong)
    assert hit >= 0.95 * n and wrong <= 0.02 * n
