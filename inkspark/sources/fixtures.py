"""Collaboration inputs derived from the driver's tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators.scan import numbered
from ..runtime import hot_keys, hot_within, materialize, shuffle_partitions

AS_OF = 1705363200  # 2024-01-16 00:00:00, the clock of the presence queries
SMALL_RING = 20  # of the queries that show a ring with a gap below it
SNAPSHOT_UNIT = 50
BATCH_UNIT = 25
NEW_ID_BASE = 1_000_000_000


def _text(col: str) -> Column:
    return F.col(col).cast("string")


class Inputs:
    """Lazily derived input tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._events: DataFrame | None = None

    def written(self) -> Inputs:
        """These inputs with the events parsed once and written, for queries that read them often
        and not their values. What follows from other columns is not written."""
        if self._events is not None:
            return self
        out = Inputs(self.spark, self.sf_dir)
        parts = shuffle_partitions(self.spark)
        out._events = self._placed(materialize(self._parsed().drop("value").repartition(parts), "events"))
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _parsed(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))

    @staticmethod
    def _placed(events: DataFrame) -> DataFrame:
        return events.withColumns(
            {"doc_id": (F.col("k") % 10).cast("string"), "sec": epoch_seconds(F.col("ts"))}
        )

    def ev(self) -> DataFrame:
        return self._placed(self._parsed()) if self._events is None else self._events

    def interactions(self) -> DataFrame:
        third = F.col("event_id") % 3
        kind = F.when(third == 0, "like").when(third == 1, "question_mark").otherwise("share")
        action = F.when(F.col("event_type").isin("error", "signup"), "remove").otherwise("add")
        return self.ev().select(
            "event_id", "ts", kind.alias("kind"), action.alias("action"), "doc_id", "user_id"
        )

    def submissions(self) -> DataFrame:
        ev = self.ev().withColumn("client_id", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")))
        hot = hot_keys(ev, ["doc_id"])
        pairs = ["doc_id", "client_id"]
        rows = numbered(ev, ["doc_id"], ["ts", "event_id"], "arrival_seq", hot)
        rows = numbered(rows, pairs, ["ts", "event_id"], "seq0", hot_within(hot, ev, pairs))
        offer = F.col("arrival_seq") - 1
        stale = (F.col("arrival_seq") % 7 == 0) & (offer % 3 == 0)
        edit = F.when(
            F.col("event_id") % 5 == 0,
            F.concat(F.lit('{"kind":"delete","count":'), (F.col("event_id") % 4).cast("string"), F.lit("}]")),
        ).otherwise(F.concat(F.lit('{"kind":"insert","text":"'), F.col("event_type"), F.lit('é"}]')))
        ops = F.concat(
            F.lit('[{"kind":"retain","count":'), (F.col("event_id") % 20).cast("string"), F.lit("},"), edit
        )
        # A few deltas are missing, torn, at a negative position, or carry attributes.
        event = F.col("event_id")
        ops = (
            F.when(event % 41 == 0, F.lit(None).cast("string"))
            .when(event % 43 == 0, F.lit('[{"kind":"ins'))
            .when(event % 37 == 0, F.lit('[{"kind":"retain","count":-3},{"kind":"insert","text":"X"}]'))
            .when(event % 29 == 0, F.lit('[{"kind":"insert","text":"b","attrs":{"bold":true}}]'))
            .otherwise(ops)
        )
        return rows.select(
            "doc_id",
            "arrival_seq",
            F.col("user_id").alias("author_id"),
            self._conn().alias("conn_id"),
            "client_id",
            (F.col("seq0") - F.when(stale, 1).otherwise(0)).alias("client_seq"),
            F.floor(offer / 3).cast("long").alias("base_revision"),
            ops.alias("ops"),
            "ts",
        )

    @staticmethod
    def _conn() -> Column:
        return F.concat(F.lit("u"), _text("user_id"), F.lit("-"), (F.col("event_id") % 2).cast("string"))

    def heartbeats(self) -> DataFrame:
        ttl = F.when(F.col("event_id") % 10 == 0, 600).otherwise(21600).cast("long")
        return self.ev().select(
            "event_id", "ts", "sec", "doc_id", "user_id",
            F.concat(F.lit("u"), _text("user_id")).alias("username"), ttl.alias("ttl"),
        )

    def loose_heartbeats(self) -> DataFrame:
        """Heartbeats of which some come before any document was joined."""
        event = F.col("event_id")
        doc = F.when(event % 53 == 0, "").when(event % 59 != 0, F.col("doc_id"))
        return self.heartbeats().withColumn("doc_id", doc)

    def cursors(self) -> DataFrame:
        is_get = F.col("event_type") == "purchase"
        return self.ev().select(
            "event_id", "ts", "sec", "doc_id", "user_id",
            F.when(is_get, "get").otherwise("set").alias("op"),
            F.when(~is_get, F.concat(F.lit('{"start":'), _text("k"), F.lit("}"))).alias("cursor_json"),
            F.lit(259200).cast("long").alias("ttl"),
        )

    def joins(self) -> DataFrame:
        return self.ev().select("event_id", "ts", self._conn().alias("conn_id"), "user_id", _text("k").alias("doc_id"))

    def join_requests(self) -> DataFrame:
        """Joins by the document a connection was opened on, by title, or by neither; a title may
        be of an old document, of one created sooner or later, or of none."""
        event = F.col("event_id")
        note = F.concat(F.lit("note/"), _text("k"))
        old = F.concat(F.lit("src"), (F.col("k") % 25).cast("string"), F.lit("/en"))
        return self.ev().select(
            "event_id", "ts", self._conn().alias("conn_id"), "user_id",
            F.when((event % 2 == 0) & (event % 8 != 2), _text("k")).alias("doc_id"),
            F.when(event % 4 == 1, note).when(event % 4 == 3, old).when(event % 8 == 2, "").alias("title"),
        )

    def member_asks(self) -> DataFrame:
        """Requests for the members of the document a connection is in, and clean-ups of it."""
        event = F.col("event_id")
        return self.ev().filter("event_id % 9 = 3 OR event_id % 50 = 8").select(
            "event_id", "ts", "sec", self._conn().alias("conn_id"), (event % 9 != 3).alias("clean")
        )

    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))

    def register_requests(self) -> DataFrame:
        key = F.col("o_orderkey")
        taken = F.concat(F.lit("Customer#"), F.lpad(_text("o_custkey"), 9, "0"))
        fresh = F.concat(F.lit("new#"), (key % 500).cast("string"))
        return self.table("orders").select(
            key.alias("request_id"), F.when(key % 3 == 0, taken).otherwise(fresh).alias("username")
        )

    def documents(self) -> DataFrame:
        return self.table("documents").select(
            _text("doc_id").alias("id"),
            (F.col("doc_id") % 100).alias("owner_id"),
            F.concat("source", F.lit("/"), "lang").alias("title"),
        )

    def title_requests(self) -> DataFrame:
        """Titles asked for: some of existing documents, some unknown."""
        lang = F.element_at(
            F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("user_id") % 4 + 1).cast("int")
        )
        title = F.concat(F.lit("src"), (F.col("k") % 25).cast("string"), F.lit("/"), lang)
        return self.ev().select("event_id", title.alias("title"))

    def create_requests(self) -> DataFrame:
        """createDocument requests: new titles, repeated titles and titles already in use."""
        title = F.when(
            F.col("event_id") % 2 == 0, F.concat(F.lit("note/"), _text("k"))
        ).otherwise(F.concat(F.lit("src"), (F.col("k") % 20).cast("string"), F.lit("/en")))
        return self.ev().filter("event_id % 9 = 1").select(
            "event_id", "ts", "sec", "user_id",
            F.concat(F.lit("u"), _text("user_id")).alias("username"), title.alias("title"),
        )

    def doc_stats(self) -> DataFrame:
        kind = F.col("kind")
        return (
            self.interactions()
            .filter("action = 'add' AND doc_id < '8'")
            .groupBy("doc_id")
            .agg(
                F.count_if(kind == "like").alias("like_count"),
                F.lit(0).cast("long").alias("view_count"),
                F.count_if(kind == "share").alias("share_count"),
                F.count_if(kind == "question_mark").alias("question_mark_count"),
            )
        )

    def stat_cache(self) -> DataFrame:
        members = F.count_distinct("user_id").cast("string")
        return (
            self.interactions()
            .filter("action = 'add' AND doc_id < '5'")
            .groupBy("doc_id", "kind")
            .agg(members.alias("cached"))
            .withColumn("cached", F.when(F.col("doc_id") == "4", "-1").otherwise(F.col("cached")))
        )

    def messages(self) -> DataFrame:
        names = ["heartbeat", "createDocument", "joinDocument", "show_alive_members", "op_submit",
                 "saveDocument", "loadDocumentContent", "setCursor", "ping"]
        kind = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 9 + 1).cast("int"))
        doc = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("doc_id"))
        delta = F.concat(
            F.lit(',"ops":[{"kind":"retain","count":'), _text("k"),
            F.lit('},{"kind":"insert","text":"m"}]'),
        )
        # Every fifth message leaves out what a client may leave out, the others carry a delta.
        rest = F.when(F.col("event_id") % 5 == 0, F.lit("}")).otherwise(
            F.concat(
                F.lit(',"baseRevision":'), _text("k"),
                F.lit(',"clientId":"c'), (F.col("user_id") % 4).cast("string"),
                F.lit('","clientSeq":'), _text("event_id"), delta, F.lit("}"),
            )
        )
        body = F.concat(F.lit('{"type":"'), kind, F.lit('","docId":"'), doc, F.lit('"'), rest)
        # Every 97th message is cut short, as a broken frame would be.
        return self.ev().select(
            "event_id",
            "ts",
            F.when(F.col("event_id") % 97 == 0, F.substring(body, 1, 20)).otherwise(body).alias("json"),
        )

    def request_params(self) -> DataFrame:
        four, eight, doc = F.col("event_id") % 4, F.col("event_id") % 8, F.col("doc_id")
        return self.ev().select(
            "event_id",
            F.when(four == 0, doc).otherwise("").alias("q_doc_id"),
            F.when(four == 1, doc).alias("q_docid_camel"),
            F.when(four == 2, doc).when(eight == 3, "").alias("h_docid"),
            F.when(eight == 7, doc).alias("h_docid_camel"),
        )

    def write_requests(self) -> DataFrame:
        """Write requests with a body document id and the caller's user id, either missing at times."""
        return self.ev().select(
            "event_id",
            F.when(F.col("event_id") % 11 != 0, F.col("doc_id")).alias("doc_id"),
            F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id"),
        )

    def ops_since_requests(self) -> DataFrame:
        lim = F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("k") % 7).cast("long")
        return self.ev().select("doc_id", F.col("k").alias("from_revision"), lim.alias("lim")).distinct()

    def document_requests(self) -> DataFrame:
        return self.joins().select("doc_id").distinct()

    def raw_counts(self) -> DataFrame:
        """Counter texts as a cache might return them, good and bad."""
        event, pick = _text("event_id"), F.col("event_id") % 6
        raw = (
            F.when(pick == 0, event)
            .when(pick == 1, F.concat(F.lit("-"), event))
            .when(pick == 2, F.concat(F.lit("+"), event))
            .when(pick == 3, F.concat(event, F.lit(".5")))
            .when(pick == 4, F.concat(F.lit(" "), event))
            .otherwise(F.concat(F.lit("9223372036854775"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))
        )
        return self.ev().select("event_id", raw.alias("raw"))

    def delta_cases(self) -> DataFrame:
        """Texts and deltas that touch the edges of the delta rules, one per event."""
        n, text = F.col("event_id") % 8, F.concat("event_type", F.lit("a😀b"), "doc_id")
        count = (F.col("k") % 9).cast("string")

        def case(template: str) -> Column:
            return F.regexp_replace(F.lit(template), "#", count)

        ops = (
            F.when(n == 0, case('[{"kind":"retain","count":5},{"kind":"insert","text":" collaborative"}]'))
            .when(n == 1, case('[{"kind":"retain","count":#},{"kind":"delete","count":4}]'))
            .when(n == 2, case('[{"kind":"retain","count":100},{"kind":"insert","text":"x"},{"kind":"insert","text":"y"}]'))
            .when(n == 3, case('[{"kind":"bogus","count":1},{"kind":"delete","count":-3},{"kind":"delete","count":99}]'))
            .when(n == 4, case('[{"kind":"retain","count":4},{"kind":"retain","count":-2},{"kind":"insert","text":"中文"}]'))
            .when(n == 5, case('[{"kind":"retain","count":1},{"kind":"insert","text":""},{"kind":"delete","count":#}]'))
            .when(n == 6, case('[{"retain":5},{"kind":"insert","text":"é","attrs":{"bold":true}}]'))
            .otherwise(case('[{"kind":"retain","count":2},{"kind":"retain","count":-#},{"kind":"insert","text":"X"}]'))
        )
        return self.ev().select("event_id", text.alias("initial"), ops.alias("ops"))
