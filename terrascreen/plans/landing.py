"""Queries of readers, writers and text checks over landed forms of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascreen.operators import keyed
from terrascreen.operators.ordering import materialise
from terrascreen.plans.registry import query
from terrascreen.plans.views import sql
from terrascreen.session import scratch_path
from terrascreen.sources import claims, files, publishing, sinks, snapshots, spatial_files


def _record(i, **fields):
    return F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items()])


@query("read_snapshot", """SELECT o_orderkey AS source, cast(p AS int) AS pos, o_orderkey||'-'||p AS id, CASE WHEN p=1 THEN NULL ELSE o_orderstatus END AS street, o_totalprice AS latitude FROM orders, (VALUES (0),(1)) v(p)""")
def read_snapshot(t):
    key = F.col("o_orderkey").cast("string")
    records = F.array(*[_record(p, id=F.concat(key, F.lit(f"-{p}")), street=F.col("o_orderstatus") if p == 0 else F.lit(None).cast("string"), latitude=F.col("o_totalprice")) for p in (0, 1)])
    landed = t.orders.select(F.to_json(F.struct(F.col("o_orderkey").alias("source"), records.alias("records"))).alias("body"))
    rows = snapshots.parse_snapshot(landed, "body", "id STRING, street STRING, latitude DOUBLE", "source BIGINT")
    return rows.select("source", "pos", "id", "street", "latitude")


@query("read_slot_history", """SELECT event_id, event_type AS feature, cast(cast(ts AS date) AS varchar) AS day_text, cast(hour(ts)*4+1 AS int) AS slot, value AS cnt, CASE WHEN event_id%4=0 THEN -1.0::double ELSE 12.5 END AS speed FROM events""")
def read_slot_history(t):
    day = F.date_format("ts", "yyyy/MM/dd")
    record = F.struct(day.alias("count_date"), (F.hour("ts") * 4 + 1).alias("time_gap"), F.col("value").alias("count"), F.when(F.col("event_id") % 4 == 0, -1.0).otherwise(12.5).alias("average_speed"))
    envelope = F.struct(F.col("event_type").alias("feature"), F.lit("2024/01/01").alias("start_date"), F.lit("2024/12/31").alias("end_date"), F.array(record).alias("records"))
    landed = t.events.select("event_id", F.to_json(envelope).alias("body"))
    parsed = snapshots.parse_snapshot(landed, "body", snapshots.SLOT_RECORD, "feature STRING, start_date STRING, end_date STRING")
    keyed_rows = parsed.withColumn("feature", F.concat_ws("|", "event_id", "feature"))
    rows = snapshots.slot_history(keyed_rows)
    parts = F.split("feature", r"\|")
    return rows.select(parts[0].cast("bigint").alias("event_id"), parts[1].alias("feature"), F.col("obs_day").cast("string").alias("day_text"), "slot", "cnt", "speed")


@query("flatten_features", sql("stations", """SELECT id, CASE WHEN ord%4=0 THEN 'fr '||street WHEN ord%4=1 THEN street ELSE street END AS street, ord%2=0 AS active, CASE WHEN ord%11=3 THEN longitude+1 ELSE longitude END AS longitude, CASE WHEN ord%7=2 THEN NULL ELSE latitude END AS latitude,
    CASE WHEN ord%7=2 THEN 'invalid_geometry' WHEN ord%11=3 THEN 'outside_envelope' END AS problem FROM stations"""))
def flatten_features(t):
    o = F.col("ord")
    lon = F.when(o % 11 == 3, F.col("longitude") + 1).otherwise(F.col("longitude"))
    coordinates = F.when(o % 7 == 2, F.array(lon)).otherwise(F.array(lon, F.col("latitude")))
    properties = F.struct(F.col("id").alias("device_name"), F.when(o % 4 != 0, F.col("street")).otherwise("  ").alias("road_en"), F.concat(F.lit("fr "), F.col("street")).alias("road_fr"), (o % 2 == 0).alias("active"))
    feature = F.struct(properties.alias("properties"), F.struct(coordinates.alias("coordinates")).alias("geometry"))
    landed = t.views.stations.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("body"))
    return snapshots.flatten_features(landed)


@query("flatten_register", sql("sites", """SELECT id, coalesce(street,'nl '||id) AS street, coalesce(district,'nl') AS district, latitude, longitude, 'Tilia' AS species, CASE WHEN ord%3=0 THEN 'nl source' ELSE 'fr source' END AS source FROM sites"""))
def flatten_register(t):
    body = F.struct("id", F.col("street").alias("address_fr"), F.concat(F.lit("nl "), F.col("id")).alias("adress_nl"), F.col("district").alias("district_fr"), F.lit("nl").alias("district_nl"), F.lit("Tilia").alias("species"),
                    F.when(F.col("ord") % 3 == 0, " ").otherwise("fr source").alias("source_fr"), F.lit("nl source").alias("source_nl"), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("geo_point_2d"))
    return snapshots.flatten_register(t.views.sites.select(F.to_json(body).alias("body")))


@query("page_set_check", """WITH n AS (SELECT o_custkey%50 AS source, sum(1+o_orderkey%3) AS n FROM orders GROUP BY 1) SELECT n.source, cast(n + CASE WHEN n.source%7=0 THEN 1 ELSE 0 END AS bigint) AS declared, cast(n AS bigint) AS n_rows,
    CASE WHEN n.source%11=0 THEN 'total_changed' WHEN n.source%7=0 THEN 'row_count' END AS problem FROM n""")
def page_set_check(t):
    source = F.col("o_custkey") % 50
    totals = t.orders.groupBy(source.alias("source")).agg(F.sum(1 + F.col("o_orderkey") % 3).alias("n"))
    pages = t.orders.select(source.alias("source"), "o_orderkey", F.sequence(F.lit(0), F.col("o_orderkey") % 3).alias("results")).join(totals, "source")
    wrong = F.when(F.col("source") % 7 == 0, 1).otherwise(0)
    moved = F.when((F.col("source") % 11 == 0) & (F.col("o_orderkey") % 2 == 1), 5).otherwise(0)
    return snapshots.page_set_check(pages.withColumn("total_count", F.col("n") + wrong + moved))


_BOUNDS = (100.0, 100.0, 400.0, 300.0)


@query("bbox_extract", sql("rects", "SELECT poly_id FROM rects WHERE x2>=100 AND x1<=400 AND y2>=100 AND y1<=300"))
def bbox_extract(t):
    """From a file in curve order, where the window test leaves out most row groups."""
    path = scratch_path(t.spark, "features")
    spatial_files.write_features(t.views.rects, path)
    return snapshots.bbox_extract(t.spark.read.parquet(path), _BOUNDS).select("poly_id")


@query("bbox_full_scan_difference", sql("rects", "SELECT poly_id, 'left_only' AS side FROM rects WHERE x2>=100 AND x1<=400 AND y2>=100 AND y1<=300 AND poly_id%97=0"))
def bbox_full_scan_difference(t):
    scanned = t.views.rects.where(snapshots.meets_window(_BOUNDS))
    indexed = snapshots.bbox_extract(t.views.rects, _BOUNDS).where(F.col("poly_id") % 97 != 0)
    return keyed.id_set_equality(scanned, indexed, "poly_id")


_IDENTITY = "fi AS (SELECT doc_id, 'doc-'||doc_id||'.txt' AS name, cast(octet_length(encode(text)) AS bigint) AS bytes, sha256(text) AS sha256 FROM documents)"


@query("file_manifest_check", f"""WITH {_IDENTITY} SELECT name, CASE WHEN doc_id % 19=0 THEN 'extra' WHEN doc_id % 23=0 THEN 'missing' WHEN doc_id % 29=0 AND n_chars IS DISTINCT FROM bytes THEN 'size' WHEN doc_id % 31=0 THEN 'digest' ELSE 'ok' END AS status
    FROM fi JOIN (SELECT doc_id AS d, n_chars FROM documents) ON d=doc_id WHERE NOT (doc_id % 19=0 AND doc_id % 23=0)""")
def file_manifest_check(t):
    """Contents of the documents as files: the size a manifest took from characters, or a digest of something else, is found."""
    key = F.col("doc_id")
    name = F.concat(F.lit("doc-"), key.cast("string"), F.lit(".txt")).alias("name")
    size = F.octet_length("text").cast("bigint")
    actual = t.documents.where(key % 23 != 0).select(name, size.alias("bytes"), F.sha2("text", 256).alias("sha256"))
    manifest = t.documents.where(key % 19 != 0).select(
        name, F.when(key % 29 == 0, F.col("n_chars")).otherwise(size).alias("bytes"), F.when(key % 31 == 0, F.sha2("lang", 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return files.file_manifest_check(actual, manifest)


# The sides of the tree of files: what a line of each holds.
_SIDES = {"left": "text", "right": "source"}
_FILE_ROWS = """fr AS (SELECT doc_id, doc_id % 12 AS bucket, 'left' AS side, coalesce(text,'') AS line FROM documents UNION ALL SELECT doc_id, doc_id % 12, 'right', coalesce(source,'') FROM documents)"""


def _file_tree(t, tampered: bool) -> str:
    """Documents as one file per side and bucket, two folders with equal names below; some of them changed, taken away or added."""
    base, bucket = scratch_path(t.spark, "tree"), F.col("doc_id") % 12
    for side, column in _SIDES.items():
        line = F.coalesce(F.col(column), F.lit(""))
        rows = t.documents.select("doc_id", bucket.alias("bucket"), line.alias("line"))
        if tampered and side == "left":
            rows = rows.withColumn("line", F.when(F.col("bucket") == 3, F.translate("line", "e", "f")).when(F.col("bucket") == 5, F.concat("line", F.lit("!"))).otherwise(F.col("line"))).where("bucket <> 7")
            rows = rows.unionByName(rows.where("bucket = 1").withColumn("bucket", F.lit(99).cast("bigint")))
        rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("line", "bucket").write.partitionBy("bucket").text(f"{base}/{side}")
    return base


def _named(identity):
    """One file per bucket, so the name that the writer drew can go."""
    return identity.withColumn("name", F.regexp_replace("name", "/part-.*", "")).where("name like '%bucket=%'")


@query("file_tree_check", f"""WITH {_FILE_ROWS}, ta AS (SELECT doc_id, bucket, side, CASE WHEN side='left' AND bucket=3 THEN translate(line,'e','f') WHEN side='left' AND bucket=5 THEN line||'!' ELSE line END AS line FROM fr WHERE NOT (side='left' AND bucket=7)
     UNION ALL SELECT doc_id, 99, side, line FROM fr WHERE side='left' AND bucket=1),
    ma AS (SELECT side||'/bucket='||bucket AS name, sum(octet_length(encode(line))+1) AS bytes, sha256(string_agg(line||chr(10), '' ORDER BY doc_id)) AS sha256 FROM fr GROUP BY 1),
    ac AS (SELECT side||'/bucket='||bucket AS name, sum(octet_length(encode(line))+1) AS bytes, sha256(string_agg(line||chr(10), '' ORDER BY doc_id)) AS sha256 FROM ta GROUP BY 1)
    SELECT name, CASE WHEN ac.bytes IS NULL THEN 'missing' WHEN ma.bytes IS NULL THEN 'extra' WHEN ac.bytes<>ma.bytes THEN 'size' WHEN ac.sha256<>ma.sha256 THEN 'digest' ELSE 'ok' END AS status, ac.sha256 AS sha256 FROM ac FULL JOIN ma USING (name)""")
def file_tree_check(t):
    """Files in two folders with equal names, written, tampered with and checked: tasks open and digest them."""
    manifest = materialise(_named(files.file_identity(t.spark, _file_tree(t, False), "part-*")), "identity")
    actual = materialise(_named(files.file_identity(t.spark, _file_tree(t, True), "part-*")), "identity")
    return files.file_manifest_check(actual, manifest).join(actual.select("name", "sha256"), "name", "left")


def _ranking(t):
    k = F.col("c_custkey")
    street = F.when(k % 10 == 0, "=SUM(1,2)").when(k % 10 == 1, 'a "quoted", one').otherwise(F.col("c_name"))
    rows = t.customer.select(F.concat(F.lit("c"), k.cast("string")).alias("id"), street.alias("street"), F.col("c_acctbal").alias("signal"))
    path = scratch_path(t.spark, "ranking")
    sinks.write_ranking_csv(rows, path, [F.desc("signal"), F.col("id")], ["id", "street", "signal"])
    return path


_CSV_SCHEMA = "rank BIGINT, id STRING, street STRING, signal DOUBLE"
_RANKED = """SELECT cast(row_number() OVER (ORDER BY c_acctbal DESC, 'c'||c_custkey) AS bigint) AS rank, 'c'||c_custkey AS id, CASE WHEN c_custkey%10=0 THEN '''=SUM(1,2)' WHEN c_custkey%10=1 THEN 'a "quoted", one' ELSE c_name END AS street, c_acctbal AS signal FROM customer"""


@query("write_ranking_csv", _RANKED)
def write_ranking_csv(t):
    return t.spark.read.schema(_CSV_SCHEMA).option("header", True).option("quote", '"').option("escape", '"').csv(_ranking(t))


@query("read_ranking_csv", f"SELECT * FROM ({_RANKED}) WHERE rank<=10")
def read_ranking_csv(t):
    return sinks.read_ranking_csv(t.spark, _ranking(t), _CSV_SCHEMA)


@query("write_report_tables", """SELECT o_orderstatus AS status, year(o_orderdate) AS yr, cast(count(*) AS bigint) AS n, CASE WHEN o_orderstatus='F' THEN NULL ELSE max(o_totalprice) END AS highest FROM orders GROUP BY 1,2""")
def write_report_tables(t):
    table = t.orders.groupBy(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("bigint").alias("yr")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("highest"))
    table = table.withColumn("highest", F.when(F.col("status") != "F", F.col("highest")))
    paths = sinks.write_report_tables({"by_year": table}, scratch_path(t.spark, "report"))
    return t.spark.read.schema("status STRING, yr BIGINT, n BIGINT, highest DOUBLE").json(paths["by_year"])


@query("validate_then_publish", """SELECT c_nationkey, cast(count(*) AS bigint) AS n, CASE WHEN count(*)>0 THEN 2 END AS version FROM customer GROUP BY 1""")
def validate_then_publish(t):
    base = scratch_path(t.spark, "publish")
    table = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))

    def rule(name, condition):
        return {name: lambda tables: tables["counts"].where(condition).select(F.lit(name).alias("rule"), F.col("c_nationkey").cast("string").alias("key"))}

    for version, problems in ((1, rule("negative", "n < 0")), (2, rule("negative", "n < 0")), (2, rule("negative", "n < 0")), (3, rule("refused", "n >= 0"))):
        try:
            publishing.validate_then_publish({"counts": table.withColumn("version", F.lit(version))}, problems, base, version)
        except ValueError:
            continue  # a version that is taken, and one that breaks its rule
    return publishing.read_published(t.spark, base, "counts")


_LEDGER = r"""lg AS (SELECT doc_id, claim, pattern, value, tolerance FROM documents, (VALUES ('licence_version','version ([0-9]+)',3.0::double,0.0::double)) v(claim,pattern,value,tolerance)
 UNION ALL SELECT doc_id, 'first_number', '([0-9]{3,9})', n_chars::double, 500.0 FROM documents UNION ALL SELECT doc_id+1, 'spoken', 'token = "([0-9a-f]+)', 1.0, 0.0 FROM documents WHERE doc_id%25=0 UNION ALL SELECT doc_id+100000000, 'gone', '([0-9]+)', 1.0, 0.0 FROM documents WHERE doc_id%50=0)"""


@query("claim_ledger", f"""WITH {_LEDGER}, q AS (SELECT lg.doc_id, claim, value, tolerance, text, coalesce(CASE WHEN claim='licence_version' THEN regexp_extract(text,'version ([0-9]+)',1) WHEN claim='first_number' THEN regexp_extract(text,'([0-9]{{3,9}})',1)
    WHEN claim='spoken' THEN regexp_extract(text,'token = "([0-9a-f]+)',1) ELSE NULL END,'') AS quoted FROM lg LEFT JOIN documents d ON d.doc_id=lg.doc_id)
    SELECT doc_id, claim, CASE WHEN text IS NULL THEN NULL ELSE quoted END AS quoted, CASE WHEN text IS NULL THEN 'missing_document' WHEN quoted='' THEN 'pattern_vanished' WHEN try_cast(quoted AS double) IS NULL OR isinf(try_cast(quoted AS double)) THEN 'not_a_number'
    WHEN abs(try_cast(quoted AS double)-value)<=tolerance THEN 'ok' ELSE 'differs' END AS status FROM q""")
def claim_ledger(t):
    d = t.documents
    fixed = d.select("doc_id", F.lit("licence_version").alias("claim"), F.lit("version ([0-9]+)").alias("pattern"), F.lit(3.0).alias("value"), F.lit(0.0).alias("tolerance"))
    number = d.select("doc_id", F.lit("first_number").alias("claim"), F.lit("([0-9]{3,9})").alias("pattern"), F.col("n_chars").cast("double").alias("value"), F.lit(500.0).alias("tolerance"))
    spoken = d.where(F.col("doc_id") % 25 == 0).select((F.col("doc_id") + 1).alias("doc_id"), F.lit("spoken").alias("claim"), F.lit('token = "([0-9a-f]+)').alias("pattern"), F.lit(1.0).alias("value"), F.lit(0.0).alias("tolerance"))
    gone = d.where(F.col("doc_id") % 50 == 0).select((F.col("doc_id") + 100000000).alias("doc_id"), F.lit("gone").alias("claim"), F.lit("([0-9]+)").alias("pattern"), F.lit(1.0).alias("value"), F.lit(0.0).alias("tolerance"))
    return claims.claim_ledger(d, fixed.unionByName(number).unionByName(spoken).unionByName(gone))


@query("claim_words", r"""SELECT doc_id, 'opening' AS claim, regexp_extract(text, '^([A-Za-z]+)', 1) AS quoted, CASE WHEN regexp_extract(text, '^([A-Za-z]+)', 1)='' THEN 'pattern_vanished' WHEN regexp_extract(text, '^([A-Za-z]+)', 1)='The' THEN 'ok' ELSE 'differs' END AS status
    FROM documents""")
def claim_words(t):
    ledger = t.documents.select("doc_id", F.lit("opening").alias("claim"), F.lit("^([A-Za-z]+)").alias("pattern"), F.lit(0.0).alias("value"), F.lit(0.0).alias("tolerance"), F.lit("The").alias("word"))
    return claims.claim_ledger(t.documents, ledger)


@query("misplaced_references", """WITH p AS (SELECT page_id AS i, page_id % 4 AS f FROM pages), ok AS (SELECT 'docs/part'||f||'/page'||i||'.md' AS path FROM p WHERE i % 7>0),
    r AS (SELECT 'docs/part'||f||'/page'||i||'.md' AS name, i % 6 AS k, CASE i % 6 WHEN 0 THEN './page'||i||'.md' WHEN 1 THEN '../part'||f||'/./page'||i||'.md' WHEN 2 THEN 'page'||i||'.md' WHEN 3 THEN 'docs/part'||f||'/' WHEN 4 THEN '../../docs/none/page'||i||'.md' ELSE '/served/'||i END AS token,
     'docs/part'||f||'/page'||i||'.md' AS own, 'docs/part'||f AS folder FROM p)
    SELECT name, token FROM r WHERE (k IN (0,1,2) AND own NOT IN (SELECT path FROM ok)) OR (k=3 AND NOT EXISTS (SELECT 1 FROM ok WHERE starts_with(path, folder||'/'))) OR k=4""")
def misplaced_references(t):
    i, f = F.col("page_id"), F.col("page_id") % 4
    text = lambda *parts: F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])
    own = text("docs/part", f, "/page", i, ".md")
    token = (F.when(i % 6 == 0, text("./page", i, ".md")).when(i % 6 == 1, text("../part", f, "/./page", i, ".md")).when(i % 6 == 2, text("page", i, ".md"))
             .when(i % 6 == 3, text("docs/part", f, "/")).when(i % 6 == 4, text("../../docs/none/page", i, ".md")).otherwise(text("/served/", i)))
    found = t.pages.select(own.alias("name"), token.alias("token"))
    return claims.misplaced_references(found, t.pages.where(i % 7 > 0).select(own.alias("path")))


_REFS = r"""rf AS (SELECT DISTINCT page_id AS doc_id, regexp_extract(tk,'^[^#]*') AS token FROM (SELECT page_id, unnest(regexp_extract_all(html,'href="([^"]*)"',1)) AS tk FROM pages)),
 ok AS (SELECT * FROM rf WHERE token<>'' AND NOT (starts_with(token,'http:') OR starts_with(token,'https:') OR starts_with(token,'mailto:') OR starts_with(token,'javascript:') OR contains(token,'*') OR contains(token,'<') OR contains(token,'{') OR contains(token,'…'))),
 pa AS (SELECT DISTINCT token||'/index' AS path FROM ok WHERE length(token)%3<>0), ls AS (SELECT string_split(path,'/') AS l FROM pa), kn AS (SELECT DISTINCT array_to_string(l[1:n],'/') AS known FROM (SELECT l, unnest(generate_series(1,len(l))) AS n FROM ls))"""


@query("reference_resolution", f"WITH {_REFS} SELECT doc_id, token FROM ok WHERE regexp_replace(token,'/+$','') NOT IN (SELECT known FROM kn WHERE known<>'')")
def reference_resolution(t):
    found = materialise(claims.references(t.pages.select(F.col("page_id").alias("doc_id"), "html"), "html", r'href="([^"]*)"'), "references")
    paths = found.where(F.length("token") % 3 != 0).select(F.concat("token", F.lit("/index")).alias("path")).distinct()
    return claims.unresolved_references(found, paths)
