from footfall.llm import warc_audit

SCHEMA = "page_id long, url string, html string"


def pages(spark, n=300):
    rows = [(k, f"http://a/{k}", f"<p>{'x' * (k * 37 % 900)}</p>") for k in range(n)]
    rows += [(7, "http://a/7", "again"), (None, None, None), (n, "http://long", "y" * 300_000)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS digest", "1 AS offset")


def test_damage_is_found_where_it_is(spark):
    records = warc_audit.warc_records(pages(spark), pages_per_file=64)
    original = warc_audit.fingerprints(records)
    rows = sorted(original.collect(), key=lambda r: (r["file"], r["offset"]))
    assert all(b["offset"] == a["offset"] + a["length"] for a, b in zip(rows, rows[1:]) if a["file"] == b["file"])
    changed = {(rows[5]["file"], rows[5]["offset"]), (rows[200]["file"], rows[200]["offset"])}
    missing = {(rows[90]["file"], rows[90]["offset"])}
    replica = [r.asDict() | ({"digest": "0" * 64} if (r["file"], r["offset"]) in changed else {}) for r in rows]
    replica = [r for r in replica if (r["file"], r["offset"]) not in missing]
    replica.append({"file": 77, "offset": 0, "length": 3, "record_id": 1, "digest": "f"})
    found = warc_audit.audit(original, spark.createDataFrame(replica, original.schema), leaf_bytes=4096, fanout=2, levels=3)
    status = {(r["file"], r["offset"]): r["status"] for r in found.collect()}
    assert status == dict.fromkeys(changed, "changed") | dict.fromkeys(missing, "missing") | {(77, 0): "extra"}


def test_intact_and_empty(spark):
    one = warc_audit.fingerprints(warc_audit.warc_records(pages(spark, 40)))
    assert warc_audit.audit(one, one).isEmpty()
    nothing = one.limit(0)
    assert warc_audit.audit(nothing, nothing).isEmpty()
    assert warc_audit.audit(one, nothing).filter("status = 'missing'").count() == 43


def test_only_differing_branches_are_read(spark, monkeypatch):
    """Below a root that agrees nothing is suspected."""
    records = warc_audit.fingerprints(warc_audit.warc_records(pages(spark), pages_per_file=64))
    tables = warc_audit.merkle_levels(records, 4096, 2, 3)
    assert tables[-1].count() == records.select("file").distinct().count()
    assert warc_audit._differing(tables[-1], tables[-1]).isEmpty()
    assert tables[0].count() >= tables[1].count() >= tables[2].count() >= tables[3].count()
