import pytest
from pyspark.sql import functions as F

from engramix import vocab
from engramix.functions import chunkers, score, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("written", "kind"),
    [
        ("-----BEGIN RSA PRIVATE KEY-----\nMIIEpAIBAAKCAQEA\n-----END RSA PRIVATE KEY-----", "pem-private-key"),
        ("AKIA" + "ABCDEFGHIJKLMNOP", "aws-access-key-id"),
        ("aws_secret_access_key=" + "a" * 40, "aws-secret-key"),
        ("sk-" + "x" * 30, "openai-key"),
        ("AIza" + "b" * 35, "gemini-key"),
        ("ghp_" + "c" * 30, "github-token"),
        ("xoxb-" + "1" * 12, "slack-token"),
        ("M" + "k" * 23 + ".AAAAAA." + "B" * 27, "discord-token"),
        ("eyJab.eyJcd.ef-gh", "jwt"),
        ("Authorization: Bearer abcdefgh123", "auth-header"),
        ("export DB_PASSWORD=hunter22", "env-secret"),
        ("card 4532 0151 1283 0366 here", "credit-card"),
        ("a <private>my\nsecret</private> b", "user-marked"),
    ],
)
def test_redaction(spark, written, kind):
    r = one(spark, text.redacted(F.col("t")), t=f"x {written}" if kind != "env-secret" else written)
    assert (r["count"], r.kinds) == (1, [kind])
    assert f"[REDACTED:{kind}]" in r.text
    again = one(spark, text.redacted(F.col("t")), t=r.text)
    assert again["count"] == 0 and again.text == r.text


def test_redaction_leaves_others(spark):
    for t in ("4532015112830367", "sk-short", "plain", ""):
        assert one(spark, text.redacted(F.col("t")), t=t).text == t


def test_luhn(spark):
    digits = {"4532015112830366": True, "4532015112830367": False, "0": True, "18": True}
    for d, valid in digits.items():
        assert one(spark, text.luhn(F.col("d")), d=d) is valid


@pytest.mark.parametrize(("comment", "found", "days"), [("<!-- retention: never -->", True, None), ("<!-- retention: 30 -->", True, 30), ("  <!-- RETENTION: 12 days -->", True, 12), ("<!-- retention: 0 -->", False, None), ("<!-- retention: 36501 -->", False, None), ("text <!-- retention: 5 -->", False, None)])
def test_retention_override(spark, comment, found, days):
    r = one(spark, text.retention_override(F.col("t")), t=f"# a\r\n{comment}\r\nb")
    assert (r.found, r.days) == (found, days)
    late = one(spark, text.retention_override(F.col("t")), t="\n" * 30 + "<!-- retention: 30 -->")
    assert late.found is False


def test_one_liner(spark):
    assert one(spark, text.one_liner(F.col("t")), t="---\n\n## **A** title\nb") == "A title"
    assert one(spark, text.one_liner(F.col("t")), t="<p>\n- " + "x" * 200) == "x" * 139 + "…"
    assert one(spark, text.one_liner(F.col("t")), t="") == ""


def test_titles_and_paths(spark):
    assert one(spark, text.title_of(F.col("p")), p="a/b.MD") == "b"
    assert one(spark, text.chunk_type(F.col("p")), p="memory/2024-01-02.md") == "daily"
    assert one(spark, text.path_kind(F.col("p")), p="entities/x.md") == "entity"
    assert str(one(spark, text.path_date(F.col("p")), p="memory/2024-01-02.md")) == "2024-01-02"
    assert one(spark, text.path_date(F.col("p")), p="memory/2024-13-99.md") is None


def test_noise(spark):
    for t, noise in (("ok", True), ("thank you done!", True), ("12345678901234", True), ("!!!???...;;;;", True), ("x" * 500, False), ("We decided to use parquet for the store", False)):
        assert one(spark, text.is_noise(F.col("t")), t=t) is noise, t


def test_facts(spark):
    got = one(spark, text.facts(F.col("t")), t="Paid R$ 8.5k to Maria Silva on 01/02/2024, 5% off, mail a.b@c.de")
    assert {r.kind for r in got} == {"value_brl", "proper_noun", "date", "percent", "email"}


def test_reasons(spark):
    for raw, verb, want in (("extends", None, "extends"), ("UNKNOWN", "requires", "depends_on"), (None, "Supersedes ", "replaces"), ("x", "y", "unknown")):
        row = spark.createDataFrame([(raw, verb)], "raw string, verb string")
        assert row.select(text.relation_reason(F.col("raw"), F.col("verb")).alias("x")).first().x == want


def test_temporal(spark):
    clock = F.lit("2026-02-10").cast("timestamp")
    for t, source, anchor in (("on 2025-01-02", "iso_date", "2025-01-02"), ("em março de 2024", "month_year", "2024-03-16"), ("in december", "month_year", "2025-12-16"), ("quando foi", "adverbial", None), ("plans 2023", "year", "2023-06-30"), ("nothing here", None, None)):
        r = one(spark, text.temporal_intent(F.col("t"), clock), t=t)
        assert (r.source, r.anchor and str(r.anchor)) == (source, anchor), t
    assert one(spark, text.is_temporal(F.col("t")), t="quando subiu?") is True


def test_links(spark):
    t = "See [a](../entities/projects/x-1.md#top), [[decisions/d2|D]] and lessons/l3. `agents/no` ```agents/never``` src/a.py:3"
    got = {(r.type, r.slug, r.source) for r in one(spark, text.links(F.col("t")), t=t)}
    assert got == {("projects", "x-1", "markdown_link"), ("decisions", "d2", "wikilink"), ("lessons", "l3", "bare_ref")}
    assert one(spark, text.code_refs(F.col("t")), t=t) == ["src/a.py:3"]


def test_salience_bounds(spark):
    clock = F.lit("2026-01-01").cast("timestamp")
    schema = "last_accessed_at timestamp, source_date date, created_at timestamp, retention_days int, chunk_type string, importance double, pain double, access_count int"
    row = spark.createDataFrame([(None, None, None, None, None, None, None, None)], schema)
    c = {k: F.col(k) for k in row.columns}
    assert row.select(score.salience(clock, c).alias("x")).first().x == pytest.approx(0.55 * 0.4 + 0.15 * 0.5 + 0.1 * 0.2)
    assert row.select(score.salience_class(F.lit(0.4)).alias("x")).first().x == "retain"
    assert row.select(score.round2(F.lit(-0.125)).alias("x")).first().x == -0.12


def test_chunk_markdown():
    long = "\n\n".join(" ".join(["word"] * 100) for _ in range(12))
    chunks = chunkers.chunk_markdown(f"# top\n{'intro ' * 30}\n## a\n{long}\n## b\nshort")
    assert all(len(c.split()) <= chunkers.MOST_WORDS + chunkers.LEAST_WORDS for c in chunks)
    assert chunks[-1].endswith("short") and len(chunks) == 4
    assert chunkers.chunk_markdown(None) == [] and chunkers.chunk_markdown("") == []
    # what is packed stays, however short; a paragraph ends at an empty line, not at one of blanks
    assert [len(c.split()) for c in chunkers.chunk_markdown(" ".join(["w"] * 497) + "\n\n" + " ".join(["v"] * 10))] == [497, 10]
    assert len(chunkers.chunk_markdown(" ".join(["w"] * 400) + "\n \n" + " ".join(["v"] * 200))) == 1


def test_chunk_json():
    assert chunkers.chunk_json('[1, {"a": 2}]') == ["1", '{\n  "a": 2\n}']
    assert chunkers.chunk_json('{"k": [1, 2], "m": 3}') == ["k: 1", "k: 2", "m: 3"]
    assert chunkers.chunk_json("not json") == ["not json"] and chunkers.chunk_json("{}") == ["{}"] and chunkers.chunk_json("5") == ["5"]
    assert chunkers.chunk_json('{"k": {"a": [1, "é"]}}') == ['k: {"a":[1,"é"]}']


def test_entity_and_frontmatter():
    t = "---\nagent: 'a1'\nreferences: [x, \"y\"]\nsupersedes:\n - z\n---\nBody\n\n## Timeline\n- 2024 one\n* two\n"
    assert chunkers.frontmatter_relations(t) == [("is_agent_of", "a1"), ("references", "x"), ("references", "y"), ("supersedes", "z")]
    assert [s for s, _ in chunkers.parse_entity(t)] == ["frontmatter", "compiled", "timeline", "timeline"]
    assert chunkers.parse_entity("plain") == [("compiled", "plain")]


def test_vocabulary_is_closed():
    assert set(vocab.REASON_OF_VERB.values()) <= set(vocab.RELATION_REASONS)
    assert set(vocab.RETENTION_DAYS) == set(vocab.CHUNK_TYPES)
