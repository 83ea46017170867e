import numpy as np
import pytest

from tidemill.llm.boosting import Boosted
from tidemill.llm.pii import TYPES, candidates, find_pii, fit, redact, redact_tables

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    seen = spark.read.parquet(f"{SF}/entities.parquet").where("chunk_id % 3 <> 0")
    return fit(spark.read.parquet(f"{SF}/chunks.parquet"), seen)


def test_held_out_labelled_values_are_found(spark, model):
    """Chunks whose labels the fit has not seen: at least 98 in 100 labelled values."""
    chunks = spark.read.parquet(f"{SF}/chunks.parquet").where("id % 3 = 0").select("id", "text")
    found = {(r.row_id, r.value) for r in find_pii(chunks, model, "id", "text").collect()}
    named = ["email", "phone", "SSN", "address", "person_name"]
    rows = (
        spark.read.parquet(f"{SF}/entities.parquet").where("entity_value is not null").where("entity_name in ('%s')" % "','".join(named))
        .join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").where("contains(text, trim(entity_value))").collect()
    )
    assert len(rows) > 500
    hit = sum((r.chunk_id, r.entity_value.strip()) in found for r in rows)
    assert hit >= 0.98 * len(rows), (hit, len(rows))


def test_no_case_among_other_entities(spark, model):
    other = spark.read.parquet(f"{SF}/entities.parquet").where("entity_name in ('EIN', 'url', 'ip_address', 'amount', 'date', 'company')")
    n = find_pii(other, model, "id", "entity_value").count()
    assert n <= 0.01 * other.count()


def test_redaction_keeps_the_rest(spark, model):
    text = "Reach Rosalind Dunwick at r.dunwick@example.com or (671) 555-0193. Project Tidal Canyon moved to $5,000 on 2024-01-02."
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "Nothing here.", 0), (1, text, 0)], "id long, text string, redacted int")
    rows = sorted(redact(df, model, "id", "text").collect(), key=lambda r: r.row_id)
    want = "Reach [PERSON_NAME] at [EMAIL] or [PHONE]. Project Tidal Canyon moved to $5,000 on 2024-01-02."
    assert [r.redacted for r in rows] == [want, want, None, "", "Nothing here."]
    assert redact(df.where("false"), model, "id", "text").count() == 0
    assert find_pii(df.where("false"), model, "id", "text").count() == 0


def test_values_of_entities_are_redacted_too(spark, model):
    chunks = spark.createDataFrame([(1, "Call (671) 555-0193.")], "id long, text string")
    ents = spark.createDataFrame([(1, "r.dunwick@example.com"), (2, None), (3, "  blue kettle "), (3, "  blue kettle ")], "id long, entity_value string")
    got = sorted((r.table_name, r.row_id, r.redacted) for r in redact_tables(chunks, ents, model).collect() if r.redacted)
    assert got == [("chunks", 1, "Call [PHONE]."), ("entities", 1, "[EMAIL]"), *[("entities", 3, "  blue kettle ")] * 2]
    assert redact_tables(chunks, ents, model).count() == 5


def test_repeated_labels_do_not_change_the_fit(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet")
    ents = spark.read.parquet("/root/testdata/sf0.01/entities.parquet")
    hot = ents.where("chunk_id % 50 = 3").selectExpr("*", "explode(sequence(1, 20)) as again").drop("again")
    one, two = fit(chunks, ents), fit(chunks, ents.unionByName(hot))
    assert one.thresholds == two.thresholds and set(one.trees) == set(TYPES)


def test_generators_propose_every_format():
    cases = [
        ("email", "a.b+c@mail.example.org"), ("email", "a_b [at] post [dot] invalid"), ("email", "ab(at)x.example"),
        ("phone", "+33 1 99 00 54 71"), ("phone", "(671) 555-0193"), ("phone", "030/23125-525"), ("phone", "01.99.00.23.00"), ("phone", "8995550157"),
        ("id_number", "967-14-6052"), ("id_number", "R4081765"), ("id_number", "Z-6523021-J"), ("id_number", "10 884 691 243"),
        ("street_address", "2588 W. Kestrel St"), ("street_address", "77 rue de la Forge"), ("street_address", "Calle de los Olivos 39"),
        ("street_address", "Mühlgrabenstr. 77"), ("street_address", "Sonnenstraße 54"),
        ("person_name", "Ida Dreschett-Dresick"), ("person_name", "Anton M. Anderbourne"), ("person_name", "Tarndor, Felix"), ("person_name", "I. Ulvingen"),
        ("person_name", "JULES GARVOVA"), ("person_name", "rafael jarrbourne"),
    ]
    for kind, value in cases:
        text = f"so it is {value}, they say"
        assert any(k == kind and text[s:e] == value for k, s, e in candidates(text, {"rafael": 3})), value
    assert {k for k, _ in cases} == set(TYPES)
    assert candidates("", {}) == []


def test_very_long_text(model):
    text = "the cache was cold. " * 20_000 + "Ask Rosalind Dunwick."
    assert [text[s:e] for s, e, *_ in model.score([text])[0]] == ["Rosalind Dunwick"]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = Boosted().fit(x[:2000], y[:2000], np.ones(2000)).predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
