"""One query per operator over the star-schema and event tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dynamic, jsontext
from .functions.method_id import method_id
from .functions.values import Typed, checked
from .operators import children, grouping, joins
from .plans.types import Array, Enum, Field, Map, Message, Scalar, Struct, Union, recursive, spec_of, to_spark
from .sources import frames, wire
from .streaming import calls, events

i32, i64, text, real = Scalar("int32"), Scalar("int64"), Scalar("string"), Scalar("float64")
LINE = Struct("Line", (Field("n", i32), Field("part", i64), Field("supp", i64), Field("qty", real)))
ORDER = Message("Order", (Field("key", i64, 1), Field("cust", i64, 2), Field("status", text, 3), Field("total", real, 4), Field("lines", Array(LINE), 5)))
NATIONS = Map(i32, text)
PROPS = Message("Props", (Field("k", i32, 1),))
STATUS = Enum("Status", (("UNKNOWN", 0), ("OPEN", 1), ("FINAL", 2), ("DONE", 2), ("PENDING", 3)))
OUTCOME = Union("Outcome", (Field("Open", Struct("Open", (Field("total", real),)), 1), Field("Final", Message("Final", (Field("priority", text, 1),)), 2)))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc): an order with its lines by number, as one message. Lines are grouped before the join, so each side is shuffled once, by the order."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    doc = F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("lines"))
    return orders.select(F.col("o_orderkey").alias("id"), doc.cast(to_spark(ORDER)).alias("doc"))


def doc() -> Typed:
    return Typed(F.col("doc"), ORDER)


_DOCS = """
WITH l AS (SELECT l_orderkey AS id, list({'n': l_linenumber, 'part': l_partkey, 'supp': l_suppkey, 'qty': l_quantity} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM lineitem GROUP BY l_orderkey),
docs AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS total, l.lines FROM orders LEFT JOIN l ON l.id = o_orderkey)
"""


@query(_DOCS + "SELECT id, id AS key, lines[1].part AS first_part, lines[-1].qty AS last_qty, CAST(NULL AS VARCHAR) AS nothing FROM docs")
def path_extract(spark, sf_dir):
    return order_docs(spark, sf_dir).select("id", doc().extract("$.key").alias("key"), doc().extract("$.lines[0].part").alias("first_part"), doc().extract("$.lines[#-1].qty").alias("last_qty"), doc().extract("$.none").alias("nothing"))


@query(_DOCS + "SELECT id, lines[2].part AS part, lines[2].n AS n FROM docs")
def path_get_arrow(spark, sf_dir):
    """The arrow operators: a sub-value with its own type, then a scalar of it."""
    line = doc()["lines"][1]
    return order_docs(spark, sf_dir).select("id", line["part"].extract().alias("part"), line["n"].extract().alias("n"))


@query(_DOCS + "SELECT id, CAST(coalesce(len(lines), 0) > 3 AS INT) AS fourth, CAST(lines IS NOT NULL AS INT) AS any_lines, 0 AS other FROM docs")
def path_exists(spark, sf_dir):
    return order_docs(spark, sf_dir).select("id", doc().exists("$.lines[3]").alias("fourth"), doc().exists("$.lines").alias("any_lines"), doc().exists("$.other").alias("other"))


@query(_DOCS + "SELECT id, 'Order' AS whole, CASE WHEN lines IS NOT NULL THEN 'Line[]' END AS many, CASE WHEN lines IS NOT NULL THEN 'float64' END AS one, CASE WHEN lines IS NOT NULL THEN 'struct' END AS kind, 'integer' AS key_kind FROM docs")
def type_names(spark, sf_dir):
    return order_docs(spark, sf_dir).select("id", doc().typeof().alias("whole"), doc().typeof("$.lines").alias("many"), doc().typeof("$.lines[0].qty").alias("one"), doc().kind("$.lines[0]").alias("kind"), doc().kind("$.key").alias("key_kind"))


@query(_DOCS + "SELECT id, CASE WHEN lines IS NULL THEN 4 ELSE 5 END::BIGINT AS fields, len(lines)::BIGINT AS lines, strlen(status)::BIGINT AS status, CASE WHEN lines IS NOT NULL THEN 4 END::BIGINT AS line FROM docs")
def lengths(spark, sf_dir):
    return order_docs(spark, sf_dir).select("id", doc().length().alias("fields"), doc().length("$.lines").alias("lines"), doc().length("$.status").alias("status"), doc().length("$.lines[0]").alias("line"))


@query("SELECT o_orderkey AS id, 1 AS valid, CAST(NULL AS VARCHAR) AS error FROM orders")
def validation(spark, sf_dir):
    return order_docs(spark, sf_dir).select("id", doc().valid().alias("valid"), doc().error().alias("error"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS valid, CASE WHEN event_id % 3 = 0 THEN '$.at: nanoseconds out of range' END AS error FROM events")
def validation_errors(spark, sf_dir):
    t = Struct("Stamp", (Field("at", Scalar("timestamp")), Field("count", Scalar("uint32"))))
    at = F.struct(F.lit(0).cast("long").alias("s"), F.when(F.col("event_id") % 3 == 0, 1_000_000_000).otherwise(5).alias("ns"), F.lit(0).alias("off_ms"))
    v = Typed(F.struct(at.alias("at"), F.lit(7).cast("long").alias("count")), t)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), v.valid().alias("valid"), v.error().alias("error"))


def _status(x):
    return F.when(x == "O", 1).when(x == "F", 2).otherwise(3).cast("long")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FINAL' ELSE 'PENDING' END AS name, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END::BIGINT AS number FROM orders")
def enum_names(spark, sf_dir):
    v = Typed(_status(F.col("o_orderstatus")), STATUS)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), v.enum_name().alias("name"), v.extract().alias("number"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Final' ELSE '#3' END AS branch, CASE o_orderstatus WHEN 'O' THEN o_totalprice END AS total, CASE o_orderstatus WHEN 'F' THEN o_orderpriority END AS priority FROM orders")
def union_branches(spark, sf_dir):
    disc = _status(F.col("o_orderstatus")).cast("smallint")
    whole = F.struct(disc.alias("disc"), F.when(disc == 1, F.struct(F.col("o_totalprice").alias("total"))).alias("Open"), F.when(disc == 2, F.struct(F.col("o_orderpriority").alias("priority"))).alias("Final"))
    v = Typed(whole, OUTCOME)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), v.branch().alias("branch"), v.extract("$.Open.total").alias("total"), v.extract("$.Final.priority").alias("priority"))


def region_maps(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(grouping.group_map(F.col("n_nationkey"), F.col("n_name"), NATIONS, F.col("n_nationkey")).alias("m"))
    return table(spark, sf_dir, "region").join(F.broadcast(nations), F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("id"), "m")


def by_key() -> Typed:
    return Typed(F.col("m"), NATIONS)



def _entries(m):
    return F.array_join(F.transform(F.map_entries(m.column), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",")


_MAPS = "WITH n AS (SELECT n_regionkey AS id, n_nationkey AS k, n_name AS v FROM nation), r AS (SELECT r_regionkey AS id FROM region) "


@query(_MAPS + "SELECT r.id, max(CASE WHEN k = 7 THEN v END) AS seven, max(CASE WHEN k = 7 THEN 1 ELSE 0 END) AS has_seven, max(CASE WHEN k = 7 THEN v END) AS by_path, count(k)::BIGINT AS n FROM r LEFT JOIN n ON n.id = r.id GROUP BY r.id")
def map_reads(spark, sf_dir):
    return region_maps(spark, sf_dir).select("id", by_key().map_get(7).extract().alias("seven"), by_key().map_has(7).alias("has_seven"), by_key().extract("$[7]").alias("by_path"), by_key().length().alias("n"))


@query(_MAPS + "SELECT r.id, string_agg(k || '=' || CASE WHEN k = 7 THEN 'SEVEN' ELSE v END, ',' ORDER BY k) || CASE WHEN max(CASE WHEN k = 7 THEN 1 END) = 1 THEN '' ELSE ',7=SEVEN' END AS put, string_agg(CASE WHEN k <> 7 THEN k || '=' || v END, ',' ORDER BY k) AS cut FROM r JOIN n ON n.id = r.id GROUP BY r.id".replace("max(CASE WHEN k = 7 THEN 1 END) = 1 THEN '' ELSE ',7=SEVEN'", "max(CASE WHEN k = 7 THEN 1 ELSE 0 END) = 1 THEN '' ELSE ',7=SEVEN'"))
def map_changes(spark, sf_dir):
    return region_maps(spark, sf_dir).select("id", _entries(by_key().map_set(7, "SEVEN")).alias("put"), _entries(by_key().map_remove(7)).alias("cut"))


@query(_DOCS + "SELECT id, 'X' AS status, CASE WHEN lines IS NOT NULL THEN 9.5 END AS qty, total FROM docs WHERE lines IS NOT NULL")
def change_set(spark, sf_dir):
    d = doc().set("$.status", "X").set("$.lines[0].qty", 9.5)
    return order_docs(spark, sf_dir).filter("doc.lines is not null").select("id", d.extract("$.status").alias("status"), d.extract("$.lines[0].qty").alias("qty"), d.extract("$.total").alias("total"))


@query(_DOCS + "SELECT id, status, len(lines)::BIGINT + 1 AS n, 1 AS first FROM docs WHERE lines IS NOT NULL")
def change_insert(spark, sf_dir):
    new = F.struct(F.lit(1).alias("n"), F.lit(2).cast("long").alias("part"), F.lit(3).cast("long").alias("supp"), F.lit(4.0).alias("qty"))
    d = doc().insert("$.status", "X").insert("$.lines[0]", new)
    return order_docs(spark, sf_dir).filter("doc.lines is not null").select("id", d.extract("$.status").alias("status"), d.length("$.lines").alias("n"), d.extract("$.lines[0].n").cast("int").alias("first"))


@query(_DOCS + "SELECT id, 'R' AS status, CASE WHEN lines IS NULL THEN NULL ELSE 0 END::BIGINT AS n FROM docs")
def change_replace(spark, sf_dir):
    d = doc().replace("$.status", "R").replace("$.lines", F.array().cast(to_spark(Array(LINE))))
    return order_docs(spark, sf_dir).select("id", d.extract("$.status").alias("status"), d.length("$.lines").alias("n"))


@query(_DOCS + "SELECT id, CAST(NULL AS VARCHAR) AS status, len(lines)::BIGINT - 1 AS n, lines[2].part AS first_part FROM docs WHERE lines IS NOT NULL")
def change_remove(spark, sf_dir):
    d = doc().remove("$.status").remove("$.lines[0]")
    return order_docs(spark, sf_dir).filter("doc.lines is not null").select("id", d.extract("$.status").alias("status"), d.length("$.lines").alias("n"), d.extract("$.lines[0].part").alias("first_part"))


@query(_DOCS + "SELECT id, len(lines)::BIGINT + 2 AS n, 8.0::DOUBLE AS last_qty FROM docs WHERE lines IS NOT NULL")
def change_append(spark, sf_dir):
    new = F.struct(F.lit(1).alias("n"), F.lit(2).cast("long").alias("part"), F.lit(3).cast("long").alias("supp"), F.lit(8.0).alias("qty"))
    d = doc().append("$.lines", new).set("$.lines[#]", new)
    return order_docs(spark, sf_dir).filter("doc.lines is not null").select("id", d.length("$.lines").alias("n"), d.extract("$.lines[#-1].qty").alias("last_qty"))


@query("SELECT o_custkey AS id, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def grouped_array(spark, sf_dir):
    a = grouping.group_array(F.col("o_orderkey"), Array(i64), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(a.alias("a")).select("id", F.array_join(F.col("a").cast("array<string>"), ",").alias("orders"))


@query("SELECT n_regionkey AS id, string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey) AS entries FROM nation GROUP BY n_regionkey")
def grouped_map(spark, sf_dir):
    return region_maps(spark, sf_dir).filter("m is not null").select("id", _entries(by_key()).alias("entries"))


@query(_DOCS + "SELECT id, (i - 1)::VARCHAR AS key, i::INT AS node, '$.\"lines\"[' || (i - 1) || ']' AS fullkey, '$.lines' AS path, 'struct' AS kind FROM (SELECT id, unnest(range(1, len(lines) + 1)) AS i FROM docs WHERE lines IS NOT NULL)".replace("'$.\"lines\"['", "'$.lines['"))
def each_child(spark, sf_dir):
    rows = children.each(order_docs(spark, sf_dir), doc(), "$.lines", ["id"])
    # ``id`` of the kept column is the order's; the node's own id comes after it
    return rows.toDF("order", "key", "value", "atom", "kind", "type", "node", "parent", "fullkey", "path").select(F.col("order").alias("id"), "key", "node", "fullkey", "path", "kind")


@query(_DOCS + "SELECT id, (6 + coalesce(5 * len(lines), -1))::BIGINT AS nodes, (4 + coalesce(4 * len(lines), 0))::BIGINT AS atoms, coalesce(5 + 5 * len(lines), 4)::INT AS last_id, CASE WHEN lines IS NULL THEN 0 ELSE 5 + 5 * (len(lines) - 1) + 1 END::INT AS last_parent FROM docs")
def tree_nodes(spark, sf_dir):
    docs = order_docs(spark, sf_dir).withColumnRenamed("id", "order")
    rows = children.tree(docs, doc(), "$", ["order"])
    return rows.groupBy(F.col("order").alias("id")).agg(F.count("*").alias("nodes"), F.count("atom").alias("atoms"), F.max("id").alias("last_id"), F.max_by("parent", "id").alias("last_parent"))


_NODES = """, o AS (SELECT id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs WHERE lines IS NOT NULL), c(k, name) AS (VALUES (1, 'n'), (2, 'part'), (3, 'supp'), (4, 'qty'))
SELECT id, 0 AS node, NULL::INT AS parent, NULL AS key, '$' AS fullkey, NULL AS atom FROM docs
UNION ALL SELECT id, 1, 0, 'key', '$."key"', id::VARCHAR FROM docs UNION ALL SELECT id, 2, 0, 'cust', '$."cust"', cust::VARCHAR FROM docs
UNION ALL SELECT id, 3, 0, 'status', '$."status"', status FROM docs UNION ALL SELECT id, 4, 0, 'total', '$."total"', total::VARCHAR FROM docs
UNION ALL SELECT id, 5, 0, 'lines', '$."lines"', NULL FROM docs WHERE lines IS NOT NULL
UNION ALL SELECT id, (1 + 5 * i)::INT, 5, (i - 1)::VARCHAR, '$."lines"[' || (i - 1) || ']', NULL FROM o
UNION ALL SELECT id, (1 + 5 * i + k)::INT, (1 + 5 * i)::INT, name, '$."lines"[' || (i - 1) || ']."' || name || '"', CASE k WHEN 1 THEN lines[i].n::VARCHAR WHEN 2 THEN lines[i].part::VARCHAR WHEN 3 THEN lines[i].supp::VARCHAR ELSE lines[i].qty::VARCHAR END FROM o, c
"""


@query(_DOCS.rstrip() + _NODES)
def tree_rows(spark, sf_dir):
    """Every node of every order, with its parent."""
    rows = children.tree(order_docs(spark, sf_dir).withColumnRenamed("id", "order"), doc(), "$", ["order"])
    return rows.select(F.col("order").alias("id"), F.col("id").alias("node"), "parent", "key", "fullkey", "atom")


@query(_DOCS + """SELECT id, '{"key":"' || id || '","uid":"00000000-0000-0000-0000-' || lpad(id::VARCHAR, 12, '0') || '"' || coalesce(',"status":"' || nullif(status, 'P') || '"', '') || ',"total":' || total || coalesce(',"lines":[' || array_to_string(list_transform(lines, lambda x: '{"n":' || x.n || ',"part":"' || x.part || '","qty":' || x.qty || '}'), ',') || ']', '') || '}' AS json FROM docs""")
def json_write(spark, sf_dir):
    """Messages with absent text and lines, a uuid, wide integers and floats; amounts have few digits, which every engine writes alike."""
    line = Struct("Line", (LINE.fields[0], LINE.fields[1], LINE.fields[3]))
    t = Message("Order", (ORDER.fields[0], Field("uid", Scalar("uuid"), 2), Field("status", text, 3), Field("total", real, 4), Field("lines", Array(line), 5)))
    lines = F.transform(F.col("doc.lines"), lambda x: F.struct(x["n"].alias("n"), x["part"].alias("part"), x["qty"].alias("qty")))
    uid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    v = Typed(F.struct("doc.key", uid.alias("uid"), F.nullif(F.col("doc.status"), F.lit("P")).alias("status"), "doc.total", lines.alias("lines")), t)
    return order_docs(spark, sf_dir).select("id", jsontext.to_json(v).alias("json"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_read(spark, sf_dir):
    v = jsontext.from_json(F.col("props"), PROPS)
    return table(spark, sf_dir, "events").select("event_type", v.extract("$.k").alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query(_DOCS + "SELECT id, cust, len(lines)::BIGINT AS n, list_sum(list_transform(lines, lambda x: x.qty))::DOUBLE AS qty, CAST(NULL AS VARCHAR) AS doc_error FROM docs")
def wire_round_trip(spark, sf_dir):
    """Values written to wire bytes and read back."""
    back = wire.read_wire(wire.write_wire(order_docs(spark, sf_dir), "doc", ORDER).drop("doc"), "wire", ORDER, "doc")
    return back.select("id", doc().extract("$.cust").alias("cust"), doc().length("$.lines").alias("n"), F.aggregate("doc.lines", F.lit(0.0), lambda a, x: a + x["qty"]).alias("qty"), "doc_error")


@query("SELECT r_regionkey AS id, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS leaves, sum(c_custkey)::BIGINT AS total, CAST(NULL AS VARCHAR) AS doc_error FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def recursive_trees(spark, sf_dir):
    """Regions over nations over customers as nodes of one message that holds itself, to wire bytes and back. Customers are grouped by nation first."""
    node = recursive(lambda below: Message("Node", (Field("value", i64, 1), *([Field("children", Array(below), 2)] if below else []))), 3)
    leaves = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("value")))).alias("children"))
    nations = table(spark, sf_dir, "nation").join(leaves, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("value"), "children"))).alias("children"))
    whole = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left").select(F.col("r_regionkey").alias("id"), F.struct(F.col("r_regionkey").cast("long").alias("value"), "children").cast(to_spark(node)).alias("doc"))
    back = wire.read_wire(wire.write_wire(whole, "doc", node).drop("doc"), "wire", node, "doc")
    values = F.flatten(F.transform("doc.children", lambda n: F.coalesce(F.transform(n["children"], lambda c: c["value"]), F.array().cast("array<bigint>"))))
    return back.select("id", F.size("doc.children").cast("long").alias("nations"), F.size(values).cast("long").alias("leaves"), F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "doc_error")


@query("SELECT p_partkey AS id, (strlen(p_name) + 5 + strlen(p_brand) + 5 + 4 + 8)::BIGINT AS size FROM part")
def wire_sizes(spark, sf_dir):
    t = Struct("Part", (Field("name", text), Field("brand", text), Field("size", i32), Field("price", real)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), wire.wire_size(t, F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))).alias("size"))


@query("SELECT user_id, count(*)::BIGINT AS frames, sum(CASE WHEN f IN (0, 16) THEN 1 ELSE 0 END)::BIGINT AS messages, sum(n)::BIGINT AS payload_bytes, max(CASE WHEN f = 16 THEN event_id END)::BIGINT AS last_cursor, count(CASE WHEN f = 2 THEN 1 END)::BIGINT AS bad FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 16 WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS f, strlen(props) AS n FROM events) GROUP BY user_id")
def frame_stream(spark, sf_dir):
    """Each user's events as byte streams of frames, one for each 10,000 events in their order, so that no user is one value; split again."""
    flags = F.when(F.col("event_id") % 5 == 0, 16).when(F.col("event_id") % 7 == 0, 2).otherwise(0)
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 10_000).alias("part"), "event_id", flags.alias("flags"), (F.col("user_id") % 1000).alias("stream_id"), F.encode("props", "UTF-8").alias("payload"), F.when(flags == 16, F.col("event_id")).alias("cursor"))
    made = frames.encode_frames(rows).groupBy("user_id", "part").agg(F.array_sort(F.collect_list(F.struct("event_id", "frame"))).alias("f")).select("user_id", F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["frame"])), "")).alias("bytes"))
    out = frames.split_frames(made, "bytes", ["user_id"])
    message = F.when(frames.is_message(F.col("flags"), F.col("payload")), 1).otherwise(0)
    return out.groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(message).alias("messages"), F.sum(F.octet_length("payload")).alias("payload_bytes"), F.max("cursor").cast("long").alias("last_cursor"), F.count("error").alias("bad"))


@query("SELECT '/GreeterService/SayHello' AS name, 1298316981::BIGINT AS id UNION ALL SELECT '/WidgetService/CreateWidget', 3905924649 UNION ALL SELECT '/WidgetService/GetWidget', 2750888615")
def method_ids(spark, sf_dir):
    names = spark.createDataFrame([("/GreeterService/SayHello",), ("/WidgetService/CreateWidget",), ("/WidgetService/GetWidget",)], "name string")
    return names.select("name", method_id(F.col("name")).alias("id"))


@query("SELECT event_type AS name, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN strlen(props) END)::BIGINT AS click_bytes FROM events GROUP BY event_type")
def any_dispatch(spark, sf_dir):
    """Values of several types in one column, told apart by their address."""
    packed = F.struct(F.concat(F.lit(dynamic.PREFIX), "event_type").alias("type_url"), F.encode("props", "UTF-8").alias("value"))
    rows = table(spark, sf_dir, "events").select(packed.alias("any"))
    return rows.groupBy(dynamic.any_name(F.col("any")).alias("name")).agg(F.count("*").alias("n"), F.sum(F.octet_length(dynamic.any_value(F.col("any"), "click"))).cast("long").alias("click_bytes"))


_HALF = "round_even(x::DOUBLE / pow(2, floor(log2(abs(x::DOUBLE))) - 7), 0) * pow(2, floor(log2(abs(x::DOUBLE))) - 7)"


@query(f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE {_HALF} END) AS h FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS "full", round(list_sum(list_transform(h, lambda x: x * x)), 6) AS rounded, h[1]::DOUBLE AS first, h[-1]::DOUBLE AS last FROM v""")
def vectors_bfloat16(spark, sf_dir):
    """Embeddings rounded to bfloat16: squared lengths before and after, and the outer elements."""
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e, F.transform(e, dynamic.bfloat16).alias("half"))
    outer = lambda n: F.element_at("half", n).cast("double")
    return rows.select("vec_id", F.round(dynamic.dot(e, e), 6).alias("full"), F.round(dynamic.dot(F.col("half"), F.col("half")), 6).alias("rounded"), outer(1).alias("first"), outer(-1).alias("last"))


@query("SELECT o_orderkey AS call_id, upper(o_orderpriority) AS result FROM orders")
def call_unary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("payload"))
    return calls.unary(rows, F.upper).select("call_id", "result")


@query("SELECT o_orderkey AS call_id, (i - 1)::INT AS pos, string_split(o_orderpriority, '-')[i] AS result FROM orders, range(1, 4) t(i) WHERE i <= len(string_split(o_orderpriority, '-'))")
def call_server_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("payload"))
    return calls.server_stream(rows, lambda p: F.split(p, "-"))


@query("SELECT user_id AS call_id, string_agg(event_type, '>' ORDER BY event_id) AS result FROM events GROUP BY user_id")
def call_client_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("payload"))
    return calls.client_stream(rows, lambda a: F.array_join(a, ">"), limit=1_000_000)


@query("SELECT user_id AS call_id, event_id AS pos, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS result FROM events")
def call_duplex(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("pos"), F.col("value").alias("payload"))
    return calls.duplex(rows, F.max).select("call_id", "pos", "result")


def batch_calls(spark, sf_dir):
    """Four calls a customer: two chains; every tenth customer's first call finds nothing, every eleventh customer's batch is out of order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch_id"), "c_name")
    rows = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(i).alias("call_id"), F.lit(m).alias("method"), F.lit(f).alias("input_from")) for p, i, m, f in ((0, 9, "upper", -1), (1, 2, "size", 9), (2, 3, "upper", -1), (3, 4, "other", 3))])
    x = c.select("batch_id", "c_name", F.explode(rows).alias("r")).select("batch_id", "c_name", "r.*")
    payload = F.when(~((F.col("batch_id") % 10 == 0) & (F.col("pos") == 0)), F.col("c_name"))
    source = F.when((F.col("batch_id") % 11 == 0) & (F.col("pos") == 0), 4).otherwise(F.col("input_from"))
    return x.select("batch_id", "pos", "call_id", "method", payload.alias("payload"), source.alias("input_from"))


@query("""
WITH c AS (SELECT c_custkey AS b, c_name, p.pos, [9, 2, 3, 4][p.pos + 1] AS call_id FROM customer, (SELECT unnest([0, 1, 2, 3]) AS pos) p)
SELECT b AS batch_id, pos, call_id,
  CASE WHEN b % 11 = 0 THEN NULL WHEN pos = 0 AND b % 10 <> 0 THEN upper(c_name) WHEN pos = 1 AND b % 10 <> 0 THEN length(c_name)::VARCHAR WHEN pos = 2 THEN upper(c_name) END AS result,
  CASE WHEN b % 11 = 0 THEN 3 WHEN pos = 3 THEN 12 WHEN pos < 2 AND b % 10 = 0 THEN 3 ELSE 0 END AS code,
  CASE WHEN b % 11 = 0 THEN 'input is not from an earlier call' WHEN pos = 3 THEN 'no such method' WHEN pos = 0 AND b % 10 = 0 THEN 'no result' WHEN pos = 1 AND b % 10 = 0 THEN 'dependency 9 failed' END AS message
FROM c""")
def call_batches(spark, sf_dir):
    return calls.run_batches(batch_calls(spark, sf_dir), {"upper": F.upper, "size": lambda p: F.length(p).cast("string")})


@query("SELECT event_id AS id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS handle FROM events")
def future_dispatch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("idem_key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return calls.dispatched(rows).select("id", "handle")


@query("SELECT user_id AS owner, event_id AS id FROM (SELECT * FROM events WHERE event_id % 9 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE event_id % 2 = 0")
def future_resolve(spark, sf_dir):
    """The even events among the 500 that a store still holds, asked for by their owner and, in vain, by another; every ninth is discarded."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("done"), (F.col("event_id") % 9 == 0).alias("discard"))
    asked = e.filter("id % 2 = 0").select("owner", "id").union(e.filter("id % 2 = 1").select(F.col("owner") + 1_000_000, "id"))
    return calls.resolved(calls.retained(e, 500), asked).select("owner", "id")


@query("""
WITH e AS (SELECT user_id, event_type, event_id AS id, ts AS moment, 0 AS freed FROM events UNION ALL SELECT user_id, event_type, NULL, ts + INTERVAL 1 SECOND, 1 FROM events WHERE event_id % 7 = 0),
t AS (SELECT *, sum(freed) OVER (PARTITION BY user_id, event_type ORDER BY moment, freed DESC, id ROWS UNBOUNDED PRECEDING) AS turn FROM e)
SELECT id, first_value(id) OVER (PARTITION BY user_id, event_type, turn ORDER BY moment, id) AS handle FROM t WHERE freed = 0""")
def future_release(spark, sf_dir):
    """Dispatches whose key is free again a second after every seventh of them was dispatched, for it is cancelled then."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("idem_key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    cancels = e.filter("id % 7 = 0").select("owner", "id", (F.col("at") + F.expr("interval 1 second")).alias("at"))
    return calls.dispatched(e, cancels).select("id", "handle")


@query("SELECT user_id + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS owner, event_id + CASE WHEN event_id % 11 = 0 THEN 1000000000 ELSE 0 END AS id, CASE WHEN event_id % 11 = 0 THEN 5 WHEN event_id % 5 = 0 THEN 7 ELSE 0 END AS code, event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 2 = 0 AS stopped FROM events")
def future_cancel(spark, sf_dir):
    """Each event's future is asked to stop: every eleventh by an unknown id, every fifth by another caller; odd ones are completed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 1, F.col("ts")).alias("done"))
    asked = e.select((F.col("owner") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("owner"), (F.col("id") + F.when(F.col("id") % 11 == 0, 1_000_000_000).otherwise(0)).alias("id"))
    return calls.cancelled(e, asked)


@query("""
WITH RECURSIVE c AS (SELECT o_orderkey AS call_id, -o_custkey AS parent_id FROM orders UNION ALL SELECT -c_custkey, -1000000000 - c_nationkey FROM customer UNION ALL SELECT -1000000000 - n_nationkey, NULL FROM nation),
r AS (SELECT call_id FROM c WHERE call_id = -1000000003 OR (call_id BETWEEN -1000000 AND -1 AND call_id % 10 = 0) UNION SELECT c.call_id FROM c JOIN r ON c.parent_id = r.call_id)
SELECT call_id FROM r""")
def call_cancellation(spark, sf_dir):
    """A tree of calls, nations over customers over orders: one nation's and every tenth customer's are stopped with all below."""
    tree = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), (-F.col("o_custkey")).alias("parent_id"))
    tree = tree.union(table(spark, sf_dir, "customer").selectExpr("-c_custkey", "-1000000000 - c_nationkey")).union(table(spark, sf_dir, "nation").selectExpr("cast(-1000000000 - n_nationkey as long)", "cast(null as long)"))
    stopped = tree.filter("call_id = -1000000003 or (call_id between -1000000 and -1 and call_id % 10 = 0)").select("call_id")
    return calls.cancelled_calls(tree, stopped)


@query("SELECT call_id, event_id, cursor::INT AS cursor FROM (SELECT user_id AS call_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS cursor FROM events) WHERE cursor > CASE WHEN call_id % 2 = 0 THEN 3 ELSE 0 END")
def cursor_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), "event_id")
    had = e.select("call_id").distinct().filter("call_id % 2 = 0").withColumn("cursor", F.lit(3))
    return calls.resumed(calls.with_cursors(e, "event_id"), had)


@query("SELECT o_orderkey AS call_id, least(o_orderdate, TIMESTAMP '1999-01-01' + INTERVAL (o_custkey % 500) DAY) AS deadline FROM orders WHERE least(o_orderdate, TIMESTAMP '1999-01-01' + INTERVAL (o_custkey % 500) DAY) > TIMESTAMP '1999-06-01'")
def call_deadlines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("parent_id"), F.col("o_orderdate").alias("deadline"))
    days = F.make_dt_interval((F.col("parent_id") % 500).cast("int"))
    parents = o.select(F.col("o_custkey").alias("parent_id")).distinct().select(F.col("parent_id").alias("call_id"), (F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")) + days).cast(dict(rows.dtypes)["deadline"]).alias("deadline"))
    return calls.within_deadline(rows, parents, F.to_timestamp_ntz(F.lit("1999-06-01 00:00:00"))).select("call_id", "deadline")


@query("SELECT event_id AS id, 'batch' AS a, event_type AS b, CASE WHEN event_id % 2 = 0 THEN 'late' ELSE 'early' END AS c FROM events")
def call_metadata(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.lit("batch"), F.lit("c"), F.lit("early"))
    up = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("event_type"), F.lit("c"), F.lit("late"))).otherwise(F.create_map(F.lit("b"), F.col("event_type")))
    m = calls.with_metadata(base, up)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *[F.try_element_at(m, F.lit(k)).alias(k) for k in "abc"])


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return events.windowed(rows).withColumn("total", F.col("total").cast("double"))


def _money(x):
    return F.sum(x.cast("decimal(18,4)")).cast("double")


_REVENUE = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def host_pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'2000-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(_money(F.col("l_quantity")).alias("sum_qty"), _money(F.col("l_extendedprice")).alias("sum_price"), F.count("*").alias("n"))


@query("SELECT n_name, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def host_join_chain(spark, sf_dir):
    """Nations are 25 rows; customers are left to the planner, which broadcasts them only while they are small."""
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return x.groupBy("n_name").agg(_money(F.col("l_quantity")).alias("qty"), F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'some' ELSE 'none' END AS orders FROM customer")
def host_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("orders", F.lit("some")).union(c.join(o, "c_custkey", "left_anti").withColumn("orders", F.lit("none")))


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def host_rollup(spark, sf_dir):
    x = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER w AS DOUBLE) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def host_window(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("k"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).over(w).cast("double").alias("running"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def host_top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def host_set_operations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "part").select("p_partkey")).exceptAll(l.filter("l_quantity > 49").select("l_partkey").distinct())


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def host_cube(spark, sf_dir):
    x = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, GROUPING(l_returnflag)::INT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def host_grouping_sets(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linenumber")], []]
    return l.groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("SELECT event_id, user_id, ts, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS click, event_type = 'purchase' AS p FROM events QUALIFY p".replace(", event_type = 'purchase' AS p FROM events QUALIFY p", " FROM events QUALIFY event_type = 'purchase'"))
def host_as_of_join(spark, sf_dir):
    """Each purchase with the last click of its user before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = e.filter("event_type = 'click'").withColumn("click", F.col("event_id"))
    return joins.as_of(e.filter("event_type = 'purchase'").drop("event_type"), clicks, ["user_id"], "ts", "event_id", ["click"])


@query("SELECT a.event_id AS start_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type <> 'click' GROUP BY a.event_id")
def host_interval_join(spark, sf_dir):
    """How many other events follow each click within six hours."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = e.filter("event_type = 'click'").select(F.col("event_id").alias("start_id"), "user_id", F.col("at").alias("from"), (F.col("at") + 6 * 3_600_000_000).alias("to"))
    return joins.within(e.filter("event_type <> 'click'"), spans, ["user_id"], "at", "from", "to", 6 * 3_600_000_000).groupBy("start_id").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE s(size) AS (SELECT 1 UNION ALL SELECT size + 7 FROM s WHERE size < 50) SELECT size, count(p_partkey) AS n FROM s LEFT JOIN part ON p_size = size GROUP BY size")
def host_recursive(spark, sf_dir):
    """A recursive common table expression, joined."""
    sizes = spark.sql("WITH RECURSIVE s(size) AS (SELECT 1 UNION ALL SELECT size + 7 FROM s WHERE size < 50) SELECT size FROM s")
    part = table(spark, sf_dir, "part")
    return sizes.join(part, F.col("p_size") == F.col("size"), "left").groupBy("size").agg(F.count("p_partkey").alias("n"))


@query("SELECT c_custkey, upper(substring(c_name, 1, 8)) AS head, md5(c_name) AS md5, sha256(c_name) AS sha256, lower(hex(encode(c_mktsegment))) AS hex, replace(c_name, '#', '-') AS dashed, strlen(c_name)::INT AS n FROM customer")
def host_text_functions(spark, sf_dir):
    c = F.col("c_name")
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.upper(F.substring(c, 1, 8)).alias("head"), F.md5(c.cast("binary")).alias("md5"), F.sha2(c, 256).alias("sha256"), F.lower(F.hex("c_mktsegment")).alias("hex"), F.replace(c, F.lit("#"), F.lit("-")).alias("dashed"), F.octet_length(c).alias("n"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INT AS days FROM orders")
def host_date_functions(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(at).alias("y"), F.quarter(at).alias("q"), F.dayofyear(at).alias("d"), F.trunc(at, "month").cast("string").alias("month"), F.datediff(at, F.to_date(F.lit("1990-01-01"))).alias("days"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS bad, o_orderkey % 3 <> 0 AS same FROM orders")
def wire_pack(spark, sf_dir):
    """Messages wrapped as they are, with a field that the type doesn't know; every third is cut short and stays out."""
    wide = Message("Wide", (Field("key", i64, 1), Field("cust", i64, 2), Field("extra", text, 9)))
    narrow = Message("Narrow", wide.fields[:2])
    doc = F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("extra"))
    rows = wire.write_wire(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), doc.alias("doc")), "doc", wide)
    cut = F.when(F.col("id") % 3 == 0, F.substring("wire", F.lit(1), F.octet_length("wire") - 1)).otherwise(F.col("wire"))
    made = wire.packed(rows.select("id", cut.alias("wire")), "wire", narrow)
    v = F.col("value")
    same = (wire.raw(v) == F.col("wire")) & (wire.spec(v) == F.lit(spec_of(narrow)))
    return made.select("id", F.col("value_error").isNotNull().alias("bad"), F.coalesce(same, F.lit(False)).alias("same"))


@query(_DOCS + "SELECT cust % 8 AS bucket, status, count(*) AS n, sum(key)::BIGINT AS keys FROM (SELECT *, id AS key FROM docs) WHERE status = 'F' GROUP BY ALL")
def generated_columns(spark, sf_dir):
    """A path's value kept as a column of its own that partitions the stored table, so that a filter on it prunes files."""
    docs = order_docs(spark, sf_dir).withColumn("status", doc().extract("$.status"))
    return docs.filter("status = 'F'").select(F.pmod(doc().extract("$.cust"), F.lit(8)).alias("bucket"), "status", doc().extract("$.key").alias("key")).groupBy("bucket", "status").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("SELECT event_id AS id, event_id % 3 <> 0 AS kept, CASE WHEN event_id % 3 = 0 THEN '$.count: not from 0 to 255' END AS reason FROM events")
def check_quarantine(spark, sf_dir):
    """Rows that hold a valid value go on, the others stand aside with the reason."""
    t = Struct("Count", (Field("count", Scalar("byte")),))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.struct(F.when(F.col("event_id") % 3 == 0, 300).otherwise(7).cast("smallint").alias("count")).alias("v"))
    good, bad = checked(rows, Typed(F.col("v"), t))
    return good.select("id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason")).union(bad.select("id", F.lit(False), "reason"))
