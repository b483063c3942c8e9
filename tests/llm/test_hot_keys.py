"""One key with most of the rows: its rows are split among tasks, and results stay whole."""

import pytest

from ledgerloom.llm import chat, components, mixing, near_copies, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def skewed(spark):
    """Plans of the SQL executions since the test began that split a hot key."""
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    store = spark._jsparkSession.sharedState().statusStore()

    def executions() -> list:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        every = store.executionsList()
        return [every.apply(k) for k in range(every.size())]

    last = max((e.executionId() for e in executions()), default=-1)

    def plans() -> list[str]:
        return [p for e in executions() if e.executionId() > last and "skew=true" in (p := e.physicalPlanDescription())]

    yield plans
    for k, v in before.items():
        spark.conf.set(k, v)


def splits(plans, key):
    return any("SortMergeJoin(skew=true)" in p and key in p for p in plans)


def test_a_hub_of_many_edges(spark, skewed):
    edges = spark.range(1, 30_000).selectExpr("id AS u", "0L AS v").unionByName(spark.range(40_000, 40_400).selectExpr("id AS u", "id + 1 AS v"))
    out = components.components(edges.repartition(6))
    assert out.where("node < 40000 and root = 0").count() == 29_999 and out.count() == 30_399
    assert splits(skewed(), "u#")


def test_many_copies_of_one_text(spark, skewed):
    docs = spark.range(20_000).selectExpr("abs(xxhash64(id)) AS doc_id", "if(id % 20 > 0, 'one text of all', concat('w', id, ' x', id, ' y', id, ' z')) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").repartition(6)
    out = simhash.simhash_components(docs)
    assert out.count() == 20_000 and out.groupBy("component_id").count().agg({"count": "max"}).first()[0] == 19_000
    assert splits(skewed(), "fp#")
    assert near_copies.one_of_each(docs).count() == 1_001


def test_many_pages_of_one_payload(spark, skewed):
    pages = spark.range(12_000).selectExpr("abs(xxhash64(id)) AS page_id", "'http://x' AS url", "if(id % 20 > 0, repeat('same ', 300), concat(id, repeat('x', 1000))) AS html").repartition(6)
    assert warc.round_trip(pages).where("record_type = 'revisit'").count() == 11_399
    assert splits(skewed(), "digest#")


def test_rows_without_ids_in_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TIED_ROWS", 100)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 256)
    docs = spark.range(6_000).selectExpr("if(id % 3 > 0, null, id) AS doc_id", "if(id % 2 = 0, 'a b c', 'd e') AS text", "'en' AS lang", "if(id % 5 > 0, 'big', 'small') AS source", "1L AS n_chars")
    total = docs.selectExpr("sum(if(text = 'd e', 2, 3))").first()[0]
    out = mixing.mix(docs)
    assert out.count() == 6_000 and out.selectExpr("sum(taken)").first()[0] == int(1.5 * total)
    assert out.where("taken > 2 * size").count() == 0
    # Wholly repeated rows tie; the cut may run through them, and the words taken are still those of the budget.
    mixed = mixing.mixed(docs)
    assert mixed.selectExpr("sum(taken)").first()[0] == int(1.5 * total)
    assert max(r.n for r in mixed.groupBy("doc_id", "text", "source").count().withColumnRenamed("count", "n").collect()) <= 4_000


def test_a_conversation_of_many_turns(spark):
    rows = spark.range(5_000).selectExpr("if(id % 3 > 0, 7L, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    out = {r.conv_id: r.n_turns for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert out[7] == 3_333 and sum(out.values()) == 5_000
