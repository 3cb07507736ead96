"""The dictionaries cover all that stands in sensitive statements; a statement has no width."""

from collections import Counter

from pyspark.sql import functions as F

from loggrove.llm import secrets


def known(spark, texts):
    counts = Counter()
    for t in texts:
        secrets.counted(t, counts)
    return secrets.dictionary(spark.createDataFrame([(k, w, n) for (k, w), n in counts.items()], "kind int, word string, n long"))


def test_every_word_of_a_sensitive_statement_counts(spark):
    far = "x " * 1000
    words = known(spark, [f"token first_name {far} secret later_name {far} bearer last_name_{i}" for i in range(2)])
    assert b"first_name" in words and b"later_name" in words and b"last_name_0" not in words


def test_code_and_identifiers(spark):
    words = known(spark, ["session = open_session(config, retries=3)", "session = open_session(config, retries=3)", "x = other(config)"])
    assert b"session = open_session(config, retries=3)" in words and b"other" not in words


def test_copied_secrets_stay_out(spark):
    assert b"Zk3" not in known(spark, ["private key Zk3Qm9Xv2LpT7Rw8 here"] * 5)


def test_statements():
    text = "token a secret b; nothing. Else\nbearer c\nkey d"
    assert [text[s:e] for s, e, _ in secrets.statements(text)] == ["token a secret b", "bearer c", "key d"]
    assert list(secrets.statements("nothing here")) == []
    assert [(s, e) for s, e, _ in secrets.statements("Password:\nabc\ndef")] == [(0, 13)]


def test_reach_is_the_statement(spark):
    key = "Zk3Qm9Xv2LpT7Rw8Yb4N"
    for width in (10, 60, 70, 5000):  # on both sides of a former limit of 64 characters
        text = f"bearer {'x ' * width}{key}"
        assert [text[s:e] for s, e in secrets.candidates(text, [])] == [key]


def test_planted_secrets_inside_documents(spark):
    """Unseen secrets in whole documents: those in a sensitive statement are found, the same strings elsewhere and ordinary identifiers aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    key = F.concat(F.translate(F.substring(F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))), 1, 23), "=", "Q"), F.lit("7z"))
    forms = F.array(*[F.concat(F.lit(a), key, F.lit(b)) for a, b in (("\nprivate_key=", "\n"), (" the bearer ", " was sent. "), ("\nPassphrase:\n", "\n"), ("\nclient_id: '", "';\n"))])
    half = F.floor(F.length("text") / 2).cast("int")
    kind = (F.col("doc_id") % 5).cast("int")
    put = F.when(kind < 4, F.element_at(forms, kind + 1)).otherwise(F.concat(F.lit("\nsession = open_session_2(retry_count_3)\nparcel "), key, F.lit("\n")))
    planted = docs.select("doc_id", F.concat(F.substring(F.col("text"), F.lit(1), half), put, F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")).alias("text"), key.alias("key"))
    want = {r.doc_id: r for r in planted.collect()}
    hit = false = 0
    for r in secrets.scan(planted).collect():
        own = want[r.doc_id]
        novel = [own.text[x.start : x.end] for x in r.found if not x.base]
        hit += r.doc_id % 5 < 4 and own.key in novel
        false += len([x for x in novel if x != own.key or r.doc_id % 5 == 4])
    planted_n = sum(d % 5 < 4 for d in want)
    print("secrets planted", planted_n, "found", hit, "wrong", false)
    assert hit >= 0.95 * planted_n and false <= 0.02 * planted_n
