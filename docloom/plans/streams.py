"""Queries on streams: run over what is there, into the shared folder; compared with their batch forms in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import items as I
from docloom.sources.shared import shared_folder
from docloom.streaming import tasks as S, timed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    # a stream reads folders: the table's file is picked by its name
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)


def _ran(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at = _folder(spark)
    S.run_available(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


_CHANGES = """WITH e AS (SELECT user_id AS task_id, event_id AS seq, CASE WHEN event_id % 50 = 49 THEN 'completed' WHEN event_type IN ('click', 'view') THEN 'running' ELSE 'queued' END AS status FROM events),
d AS (SELECT *, min(CASE WHEN status = 'completed' THEN seq END) OVER (PARTITION BY task_id) AS stop, lag(status) OVER (PARTITION BY task_id ORDER BY seq) AS prev FROM e)
SELECT task_id, seq, status FROM d WHERE status IS DISTINCT FROM prev AND (stop IS NULL OR seq <= stop)"""


@query(_CHANGES)
def stream_status_changes(spark, sf_dir):
    """R2."""
    status = F.when(F.col("event_id") % 50 == 49, "completed").when(F.col("event_type").isin("click", "view"), "running").otherwise("queued")
    return _ran(spark, S.status_changes(_events(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))))


@query("""WITH e AS (SELECT user_id AS key, event_id AS seq, event_id % 4 = 0 AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY key ORDER BY seq) AS island FROM e),
f AS (SELECT key, seq, (count(*) FILTER (NOT ok) OVER (PARTITION BY key, island ORDER BY seq))::BIGINT AS failures FROM r) SELECT key, seq, failures, max(failures) OVER (PARTITION BY key ORDER BY seq) >= 5 AS locked FROM f""")
def stream_lockouts(spark, sf_dir):
    """R6."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 0).alias("ok"))
    return _ran(spark, S.lockouts(e, 5))


@query("SELECT user_id AS task_id, min(event_id) AS seq, event_type AS step FROM events GROUP BY ALL")
def stream_first_steps(spark, sf_dir):
    """R5."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("["), "event_type", F.lit("] done")).alias("message"))
    return _ran(spark, S.first_steps(e))


@query(f"WITH {I.USAGE_SQL} SELECT component, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, count(*) AS calls FROM usage GROUP BY ALL")
def stream_usage(spark, sf_dir):
    """R10."""
    at = _folder(spark)
    return S.latest_available(S.live_usage(I.usage(_events(spark, sf_dir))), f"{at}/out", f"{at}/checkpoint")


@query("SELECT event_id % 700 AS id, min(event_id) IS NOT NULL AS seen FROM events GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    """Ids are forgotten after 31 days, the table's span."""
    e = _events(spark, sf_dir).select((F.col("event_id") % 700).alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("seen"))
    return _ran(spark, S.deduplicated(e, "id", "ts", "31 days")).select("id", "seen")


_END = "(SELECT max(epoch_ms(ts)) - 3600000 AS mark FROM {})"


@query(f"""WITH s AS (SELECT user_id AS session_id, ts, event_id AS seq FROM events WHERE event_id % 23 = 0), o AS (SELECT *, lag(ts) OVER w AS prev, lead(ts) OVER w AS next FROM s WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq))
SELECT session_id, 'locked' AS kind, ts AS at FROM o WHERE prev IS NULL OR ts >= prev + INTERVAL 7 DAY
UNION ALL SELECT session_id, 'freed', ts + INTERVAL 7 DAY FROM o WHERE next >= ts + INTERVAL 7 DAY OR (next IS NULL AND epoch_ms(ts + INTERVAL 7 DAY) < (SELECT mark FROM {_END.format('s')}))""")
def stream_weekly_locks(spark, sf_dir):
    """Locks and their ends by timers."""
    e = _events(spark, sf_dir).where("event_id % 23 = 0").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _naive(_ran(spark, timed.weekly_locks(e)), "at")


def _naive(df: DataFrame, column: str) -> DataFrame:
    """The column as a time without zone, as the tables' own."""
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS session, ts, event_id AS seq, CASE WHEN event_type IN ('signup', 'click') THEN 'open' WHEN event_type = 'purchase' THEN 'complete' ELSE 'part' END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS nth FROM e WHERE kind <> 'part'),
w AS (SELECT session, 0::BIGINT AS nth, NULL::TIMESTAMP AS opened, NULL::TIMESTAMP AS expired, NULL::TIMESTAMP AS completed FROM (SELECT DISTINCT session FROM n)
 UNION ALL SELECT n.session, n.nth, CASE WHEN live IS NOT NULL THEN CASE WHEN n.kind = 'open' THEN live END WHEN n.kind = 'open' THEN n.ts END, CASE WHEN w.opened IS NOT NULL AND live IS NULL THEN w.opened + INTERVAL 12 HOUR END, CASE WHEN live IS NOT NULL AND n.kind = 'complete' THEN n.ts END
 FROM (SELECT *, opened AS o FROM w) w JOIN n ON n.session = w.session AND n.nth = w.nth + 1, LATERAL (SELECT CASE WHEN n.ts < w.opened + INTERVAL 12 HOUR THEN w.opened END AS live) q)
SELECT session, 'expired' AS outcome, expired AS at FROM w WHERE expired IS NOT NULL UNION ALL SELECT session, 'completed', completed FROM w WHERE completed IS NOT NULL
UNION ALL SELECT session, 'expired', opened + INTERVAL 12 HOUR FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY nth DESC) AS back FROM w) WHERE back = 1 AND opened IS NOT NULL AND epoch_ms(opened + INTERVAL 12 HOUR) < (SELECT mark FROM {_END.format('events')})""")
def stream_upload_sessions(spark, sf_dir):
    """Sessions that are completed or expire."""
    kind = F.when(F.col("event_type").isin("signup", "click"), "open").when(F.col("event_type") == "purchase", "complete").otherwise("part")
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return _naive(_ran(spark, timed.upload_sessions(e, 720)), "at")


@query("SELECT user_id AS task_id, event_id AS id, min(ts) AS ts FROM events GROUP BY ALL")
def stream_log_tail(spark, sf_dir):
    """Lines that come twice are read once."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    twice = e.select("task_id", "id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return _naive(_ran(spark, timed.log_tail(twice)), "ts")
