"""Queries over printed and tagged text, personal data, samples, spans, logs, windows and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import evaluate, extract, redact, sampling, spans
from ..schema import RAW_SCHEMA
from ..sources import testdata as td
from ..sources.manifest import latest_corrections
from ..streaming import events as ev
from .registry import query



def _none() -> Column:
    return F.lit(None).cast("string")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its raw line items: description, quantity and amount as text."""
    kind = RAW_SCHEMA["line_items"].dataType.elementType
    lines = td.line_items(spark, sf_dir).select("doc_id", "line_index", "description", F.col("quantity").cast("int").cast("string").alias("quantity"), F.col("amount").cast("string").alias("amount"))
    item = F.struct("line_index", F.struct(*((F.concat("description", F.lit(" <&>")) if n == "description" else F.col(n) if n in ("quantity", "amount") else _none()).alias(n) for n in kind.fieldNames())).alias("item"))
    return lines.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "description", item.alias("i")))), lambda x: x["i"]["item"]).alias("items"))


_MONEY = "(amt // 100) || '.' || lpad((amt % 100)::VARCHAR, 2, '0')"
RENDER_SQL = f"""{td.ITEMS_SQL}, rendered AS (SELECT doc_id, '<s_line_items>' || string_agg('<s_description>' || description || ' &lt;&amp;&gt;</s_description><s_quantity>' || qty || '</s_quantity><s_amount>' || {_MONEY} || '</s_amount>',
  '<sep/>' ORDER BY line_index) || '</s_line_items>' AS tagged FROM items GROUP BY doc_id)"""


@query("tag_render", f"WITH {RENDER_SQL} SELECT doc_id, tagged FROM rendered")
def tag_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("doc_id", codec.render_head_b(F.col("items")).alias("tagged"))


@query("tag_round_trip", f"WITH {td.ITEMS_SQL} SELECT doc_id, line_index, description || ' <&>' AS description, qty::VARCHAR AS quantity, {_MONEY} AS amount FROM items")
def tag_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _items(spark, sf_dir).select("doc_id", F.posexplode(codec.parse_head_b(codec.render_head_b(F.col("items")))).alias("line_index", "i"))
    return parsed.select("doc_id", "line_index", "i.description", "i.quantity", "i.amount")


@query(
    "tag_parse_truncated",
    f"""WITH {td.ITEMS_SQL}, n AS (SELECT doc_id, max(line_index) AS last FROM items GROUP BY doc_id)
    SELECT doc_id, line_index, CASE WHEN line_index = last THEN NULL ELSE {_MONEY} END AS amount FROM items JOIN n USING (doc_id)""",
)
def tag_parse_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences cut inside their last amount keep the other fields of that row."""
    tagged = _items(spark, sf_dir).select("doc_id", codec.render_head_b(F.col("items")).alias("t"))
    cut = tagged.select("doc_id", F.regexp_replace("t", r"\d</s_amount></s_line_items>$", "").alias("t"))
    return cut.select("doc_id", F.posexplode(codec.parse_head_b(F.col("t"))).alias("line_index", "i")).select("doc_id", "line_index", "i.amount")


@query("tag_pairs_in_order", f"WITH {RENDER_SQL}, t AS (SELECT doc_id, regexp_extract_all(tagged, '<s_([a-z_]+)>[^<]', 1) AS a FROM rendered) SELECT doc_id, len(a)::INT AS n, array_to_string(a, ',') AS tags FROM t")
def tag_pairs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _items(spark, sf_dir).select("doc_id", codec.tag_pairs(codec.render_head_b(F.col("items"))).alias("p"))
    return pairs.select("doc_id", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["tag"]), ",").alias("tags"))


@query("repetition_loops")
def repetition_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents; SQL engines have no reference back to a group, so the test has another matcher."""
    return td.table(spark, sf_dir, "documents").select("doc_id", codec.has_repetition_loop(F.col("text")).alias("loops"))


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed bill for each order with lines, which are dealt by order once and sorted there as ``td.line_items`` numbers them."""
    orders = td.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string").alias("total"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    lines = td.table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    parts = td.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    quantity, amount = F.col("l_quantity").cast("decimal(18,4)").cast("int"), F.round("l_extendedprice", 2).cast("decimal(18,2)")
    said = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    printed = F.concat(F.lit("  "), said(F.col("p_name")), F.lit("   "), said(quantity), F.lit("  10.00  "), said(amount))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct(*order, printed.alias("row")).alias("line"))
    numbered = F.transform(F.sort_array(F.collect_list("line")), lambda x, i: F.concat((i + 1).cast("string"), x["row"]))
    bills = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(numbered, "\n").alias("rows"))
    head = F.concat(
        F.lit("City Hospital\nPatient Name : P"), F.col("o_orderkey").cast("string"), F.lit("   UHID : U"), F.col("o_orderkey").cast("string"),
        F.lit("\nAge / Sex : 45 / M\nAdmission : "), F.col("d"), F.lit("\nGSTIN 27AAPFU0939F1ZV\n"), F.col("rows"), F.lit("\nGross Amount : "), F.col("total"), F.lit("\n"),
    )
    return orders.join(bills, F.col("o_orderkey") == F.col("doc_id")).select("doc_id", head.alias("text"))


@query(
    "extract_labels",
    """SELECT o_orderkey AS doc_id, 'City Hospital' AS hospital, '27AAPFU0939F1ZV' AS gstin, 'P' || o_orderkey AS patient, 'U' || o_orderkey AS uhid, '45 / M' AS age, 'M' AS sex,
    strftime(o_orderdate::DATE, '%d/%m/%Y') AS admitted, (round(o_totalprice * 100)::BIGINT // 100) || '.' || lpad((round(o_totalprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS gross
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)""",
)
def extract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("hospital.name", "hospital.gstin", "patient.name", "patient.uhid", "patient.age", "patient.sex", "patient.admission_date", "totals.gross_amount")
    read = _bills(spark, sf_dir).select("doc_id", extract.extract_rules(F.col("text"), wanted).alias("d"))
    return read.select(
        "doc_id", F.col("d.hospital.name").alias("hospital"), "d.hospital.gstin", F.col("d.patient.name").alias("patient"), "d.patient.uhid", "d.patient.age", "d.patient.sex",
        F.col("d.patient.admission_date").alias("admitted"), F.col("d.totals.gross_amount").alias("gross"),
    )


@query("extract_rows", f"WITH {td.ITEMS_SQL} SELECT doc_id, line_index, (line_index + 1)::VARCHAR AS serial_no, description, qty::VARCHAR AS quantity, {_MONEY} AS amount FROM items")
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _bills(spark, sf_dir).select("doc_id", extract.extract_rows(extract.printed_lines(F.col("text")), ("serial_no", "description", "quantity", "amount")).alias("r"))
    return read.select("doc_id", F.posexplode("r").alias("line_index", "i")).select("doc_id", "line_index", "i.serial_no", "i.description", "i.quantity", "i.amount")


@query("extract_heuristic")
def extract_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy labels have no SQL."""
    read = extract.extract_heuristic(_bills(spark, sf_dir))
    d = F.col("document")
    return read.select("doc_id", d["patient"]["uhid"].alias("uhid"), d["totals"]["gross_amount"].alias("gross"), F.size(d["line_items"]).alias("n_rows"))


# The five shapes; a match is the group, as look-around has no equal here.
_SCAN = {
    "aadhaar": "(?:^|[^0-9])([2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4})(?:[^0-9]|$)",
    "pan": "(?:^|[^A-Z0-9])([A-Z]{5}[0-9]{4}[A-Z])(?:[^A-Z0-9]|$)",
    "phone": "(?:^|[^0-9])((?:[+]?91[ -]?)?[6-9][0-9]{9})(?:[^0-9]|$)",
    "email": r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+)",
    "gstin": "(?:^|[^A-Z0-9])([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9])(?:[^A-Z0-9]|$)",
}


@query(
    "pii_lines",
    "WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"
    + " UNION ALL ".join(f" SELECT doc_id, line_no::INT AS line_no, '{k}' AS kind, unnest(regexp_extract_all(line, '{p}', 1)) AS found FROM l WHERE NOT contains(line, 'pii-allow')" for k, p in _SCAN.items()),
)
def pii_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of the five shapes of personal data on lines of documents."""
    return redact.scan_text(td.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


KEY = redact.RedactionKey(bytes(range(64)))


def _hmac_sql(key: bytes, message: str) -> str:
    """HMAC-SHA256 under a key of at most 64 bytes as lowercase hex, from two nested hashes."""
    pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in key.ljust(64, b"\0"))
    return f"sha256('{pad(0x5C)}'::BLOB || unhex(sha256('{pad(0x36)}'::BLOB || encode({message}))))"


@query(
    "keyed_surrogates",
    f"""WITH h AS (SELECT c_custkey, c_name, {_hmac_sql(KEY.material, "'patient.name:' || c_name")} AS stream FROM customer),
    b AS (SELECT c_custkey, i, c_name[i] AS ch, ('0x' || stream[2 * i - 1:2 * i])::INT AS byte FROM h, unnest(range(1, len(c_name) + 1)) t(i))
    SELECT c_custkey, string_agg(CASE WHEN ch BETWEEN '0' AND '9' THEN (byte % 10)::VARCHAR WHEN ch BETWEEN 'A' AND 'Z' THEN chr(65 + byte % 26)
      WHEN ch BETWEEN 'a' AND 'z' THEN chr(97 + byte % 26) ELSE ch END, '' ORDER BY i) AS surrogate FROM b GROUP BY c_custkey""",
)
def keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of any length; the SQL reads one digest, as names of these tables are shorter than it."""
    customers = td.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.select("c_custkey", redact.surrogate(F.col("c_name"), KEY, "patient.name").alias("surrogate"))


@query("redacted_text", None)
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = td.table(spark, sf_dir, "documents").select("doc_id", redact.redact_text(F.col("text"), KEY).alias("r"))
    return out.select("doc_id", F.sha2("r.text", 256).alias("text_sha256"), *(f"r.{n}" for n in redact.TEXT_PATTERNS))


SPLIT_SQL = "x AS (SELECT p_partkey, p_type, p_brand, CASE WHEN (p_partkey // 21) % 10 < 8 THEN 'train' WHEN (p_partkey // 21) % 10 = 8 THEN 'val' ELSE 'synth_test' END AS split FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", sampling.split_for(F.col("p_partkey")).alias("split"))


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT p_partkey, split FROM x")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", "split")


@query("split_counts", f"WITH {SPLIT_SQL} SELECT split, count(*) AS n FROM x GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_counts(_parts(spark, sf_dir))


@query("class_balance", f"WITH {SPLIT_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS key, {k} AS value, count(*) AS n FROM x GROUP BY {k}" for k in ("split", "p_type", "p_brand")))
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_balance(_parts(spark, sf_dir), ["split", "p_type", "p_brand"])


@query(
    "stratified_sample",
    f"""WITH {SPLIT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey * 7919 % 10007, p_partkey) AS turn FROM x)
    SELECT p_partkey, p_type FROM (SELECT * FROM r ORDER BY turn, p_type LIMIT 100)""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(F.col("p_partkey") * 7919 % 10007, "p_partkey")
    return sampling.stratified_sample(_parts(spark, sf_dir), ["p_type"], 100, order).select("p_partkey", "p_type")


@query("manifest_digest", "SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT sha256(p_name || p_partkey) AS h FROM part)")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = td.table(spark, sf_dir, "part").select(F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")), 256).alias("h"))
    return sampling.manifest_hash(parts, "h")


@query(
    "corpus_digest",
    """WITH h AS (SELECT sha256(p_name || p_partkey) AS h FROM part), s AS (SELECT left(h, 2) AS shard, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
    SELECT sha256(string_agg(d, '' ORDER BY shard)) AS digest FROM s""",
)
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = td.table(spark, sf_dir, "part").select(F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")), 256).alias("h"))
    return sampling.corpus_hash(parts, "h")


@query("top_k_by_category", "SELECT p_type, p_brand, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE rank <= 3")
def top_k_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = td.table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return sampling.top_k(counts, ["p_type"], [F.desc("n"), F.col("p_brand")], 3)


SPAN_SQL = """t AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS idx, l_partkey % 4 AS m FROM lineitem),
g AS (SELECT *, CASE m WHEN 0 THEN 'O' WHEN 1 THEN 'B-patient.name' WHEN 2 THEN 'I-patient.name' ELSE 'I-patient.uhid' END AS label FROM t),
p AS (SELECT *, lag(label, 1, 'O') OVER (PARTITION BY page_id ORDER BY idx) AS before FROM g),
r AS (SELECT *, sum((label = 'O' OR label[1] = 'B' OR before[3:] <> label[3:])::INT) OVER (PARTITION BY page_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM p)"""


@query("bio_spans", f"WITH {SPAN_SQL} SELECT page_id, min(label[3:]) AS path, min(idx)::INT AS start, string_agg('w' || idx, ' ' ORDER BY idx) AS text FROM r WHERE label <> 'O' GROUP BY page_id, run")
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = td.table(spark, sf_dir, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"))
    m = F.col("l_partkey") % 4
    label = F.when(m == 0, "O").when(m == 1, "B-patient.name").when(m == 2, "I-patient.name").otherwise("I-patient.uhid")
    tokens = lines.select(F.col("l_orderkey").alias("page_id"), idx.alias("idx"), label.alias("label"))
    tokens = tokens.withColumn("text", F.concat(F.lit("w"), F.col("idx").cast("string")))
    for c in ("x0", "y0", "x1", "y1"):
        tokens = tokens.withColumn(c, F.col("idx").cast("double"))
    return spans.decode_spans(tokens).select("page_id", "path", "start", "text")


@query("box_rows")
def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of printed lines back to lines; geometry has no SQL."""
    lines = td.line_items(spark, sf_dir)
    y = F.col("line_index") * 20.0
    box = lambda x, t: F.struct(F.lit(x).alias("x0"), y.alias("y0"), (F.lit(x) + 8.0 * F.char_length(t)).alias("x1"), (y + 10.0).alias("y1"), t.alias("text"), F.lit(0.9).alias("score"))
    boxes = lines.select(F.col("doc_id").alias("page_id"), F.inline(F.array(box(0.0, F.col("description")), box(400.0, F.col("amount").cast("string")))))
    return spans.boxes_to_lines(boxes)


@query("latest_correction", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = td.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return latest_corrections(log, ("user_id", "event_type"), "ts", "event_id").select("user_id", "event_type", "event_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("events_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.tumbling(_events(spark, sf_dir))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "events_sliding",
    """SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS s FROM events, range(4) t(k)) GROUP BY ALL""",
)
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sliding(_events(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(
    "events_session",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, s""",
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(_events(spark, sf_dir)).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = td.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    customers = td.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return orders, customers


@query("set_union", "SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _sides(spark, sf_dir)
    return orders.union(customers).distinct()


@query("set_intersect", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _sides(spark, sf_dir)
    return orders.intersect(customers)


@query("set_except", "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line."""
    orders = td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return orders.subtract(td.table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("distinct_slice_keys", "SELECT DISTINCT 'status' AS key, o_orderstatus AS value FROM orders UNION SELECT DISTINCT 'priority', o_orderpriority FROM orders")
def distinct_slice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return evaluate.slices(td.table(spark, sf_dir, "orders").select(meta.alias("meta")), "meta", []).select("key", "value")


@query("whitespace_tokens", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::INT AS n FROM documents")
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"))
