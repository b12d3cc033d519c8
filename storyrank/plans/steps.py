"""Queries of single model and feed steps, each beside the SQL that checks it by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.config import TopicConfig
from storyrank.functions import text
from storyrank.operators import cluster, embed, epochs, features, kmeans, lsa, nearest, rank, topics
from storyrank.operators.clean import clean_posts
from storyrank.operators.corpus import distinct_texts
from storyrank.operators.metrics import metric_rows, stored_with_counts
from storyrank.operators.prefix import running_totals
from storyrank.plans import hot_news as plan
from storyrank.plans import views
from storyrank.plans.oracle import ORACLES as BASE_ORACLES
from storyrank.plans.oracle import _sql
from storyrank.sources import models
from storyrank.sources import news as news_source
from storyrank.sources.scratch import scratch_path
from storyrank.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TOPIC = TopicConfig()
_STEPS = 5
_SMOOTH = 0.1


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------------------- search


@query
def nearest_vectors_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of all vectors for every vector whose id is divisible by 50."""
    rows = views.vectors(spark, sf_dir).select("vec_id", "vector")
    found = nearest.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), 10, key="vec_id")
    return found.select("example", "rank", "vec_id", F.round("similarity", 4).alias("similarity"))


ORACLES["nearest_vectors_all"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0
),
pairs AS (
  SELECT x.vec_id AS example, y.vec_id, round(list_cosine_similarity(x.e, y.e), 9) AS s
  FROM v x JOIN v y ON x.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY s DESC, vec_id) AS rank FROM pairs)
SELECT example, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 4) AS similarity FROM ranked WHERE rank <= 10
"""


# ---------------------------------------------------------------------------- topics


def _source_topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(words, topic-term table): each source is a topic over the 500 most frequent terms."""
    posts = views.posts(spark, sf_dir).select("id_str", "tweet", "seq", "source")
    docs = plan.build_corpus(posts).select("id_str", "source", text.split_words(F.col("clean")).alias("words"))
    terms = features.frequent_terms(docs, _TOPIC.min_df, _TOPIC.max_features).select("term")
    return docs, topics.group_topics(docs, "source", plan.stored(terms, "topic-vocabulary"), _SMOOTH)


@query
def topic_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the source topics in every post after five steps, and which is the largest."""
    return _folded(*_source_topics(spark, sf_dir))


@query
def saved_topics_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `topic_fold_in`, with the topics written as a model and loaded again."""
    docs, table = _source_topics(spark, sf_dir)
    path = scratch_path(spark, "topic-model")
    models.save_model(spark, path, {"topics": table}, {"steps": _STEPS})
    return _folded(docs, models.load_model(spark, path).tables["topics"])


def _folded(docs: DataFrame, table: DataFrame) -> DataFrame:
    names = F.sort_array(F.lit([r["topic"] for r in table.select("topic").distinct().collect()]))
    mixed = topics.fold_in(docs, table, _STEPS)
    long = mixed.select("id_str", F.col("topic").alias("largest"), F.posexplode("mix").alias("at", "share"))
    topic = F.get(names, F.col("at"))
    return long.select(
        "id_str", topic.alias("topic"), F.round("share", 6).alias("share"), (topic == F.col("largest")).alias("best")
    )


@query
def heaviest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten heaviest words of each source topic."""
    found = topics.heaviest_words(_source_topics(spark, sf_dir)[1], _TOPIC.words_per_topic)
    return found.select("topic", "rank", "term", F.round("weight", 9).alias("weight"))


def _topic_tables() -> str:
    """Chain of tables up to the topic-term table `phi`."""
    base = _sql("", "counted")
    return base.rstrip() + f""",
frequent AS MATERIALIZED (SELECT term FROM counted GROUP BY term HAVING count(*) >= {_TOPIC.min_df}
  ORDER BY sum(tf) DESC, term LIMIT {_TOPIC.max_features}),
cells AS MATERIALIZED (SELECT id_str, source, term, tf FROM counted SEMI JOIN frequent USING (term)
  JOIN corpus USING (id_str)),
groups AS MATERIALIZED (SELECT source AS topic, sum(tf) AS whole FROM cells GROUP BY source),
sums AS MATERIALIZED (SELECT source AS topic, term, sum(tf) AS n FROM cells GROUP BY source, term),
phi AS MATERIALIZED (SELECT g.topic, f.term, (coalesce(n, 0) + {_SMOOTH})::DOUBLE
  / (whole + {_SMOOTH} * (SELECT count(*) FROM frequent)) AS weight
  FROM groups g CROSS JOIN frequent f LEFT JOIN sums s ON s.topic = g.topic AND s.term = f.term)"""


def _fold_oracle() -> str:
    chain = _topic_tables() + """,
share0 AS MATERIALIZED (SELECT d.id_str, g.topic, 1.0::DOUBLE / (SELECT count(*) FROM groups) AS s
  FROM (SELECT DISTINCT id_str FROM cells) d CROSS JOIN groups g)"""
    for step in range(_STEPS):
        chain += f""",
part{step} AS (SELECT c.id_str, p.topic, c.tf * s.s * p.weight / sum(s.s * p.weight) OVER (PARTITION BY c.id_str, c.term) AS r
  FROM cells c JOIN phi p ON p.term = c.term JOIN share{step} s ON s.id_str = c.id_str AND s.topic = p.topic),
share{step + 1} AS MATERIALIZED (SELECT id_str, topic, sum(r) / sum(sum(r)) OVER (PARTITION BY id_str) AS s
  FROM part{step} GROUP BY id_str, topic)"""
    return chain + f"""
SELECT id_str, topic, round(s, 6) AS share,
  row_number() OVER (PARTITION BY id_str ORDER BY round(s, 9) DESC, topic) = 1 AS best FROM share{_STEPS}"""


ORACLES["topic_fold_in"] = ORACLES["saved_topics_fold_in"] = _fold_oracle()
ORACLES["heaviest_words"] = _topic_tables() + f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 9) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM phi)
WHERE rank <= {_TOPIC.words_per_topic}"""


# ---------------------------------------------------------------------------- epochs


@query
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every post in two training epochs."""
    posts = views.posts(spark, sf_dir).select("id_str", "seq")
    return epochs.epoch_order(posts, ["seq"], [0, 1]).select("id_str", "epoch", "place")


def _epoch_oracle(seed: int = 42) -> str:
    def mixed(value: str, step: int, side: str) -> str:
        named = f"'{seed}:' || epoch || ':{step}{side}:' || {value}"
        return f"CAST('0x' || substr(md5({named}), 1, 8) AS BIGINT)"

    def once(source: str) -> str:
        """One pass over column x of a table with n, a, b, epoch."""
        inner = f"SELECT *, x // b AS l0, x % b AS r0 FROM {source}"
        for k in range(1, epochs.ROUNDS + 1):
            inner = f"SELECT *, (l{k - 1} + {mixed(f'r{k - 1}', k, 'l')}) % a AS l{k} FROM ({inner})"
            inner = f"SELECT *, (r{k - 1} + {mixed(f'l{k}', k, 'r')}) % b AS r{k} FROM ({inner})"
        return f"SELECT id_str, epoch, n, a, b, l{epochs.ROUNDS} * b + r{epochs.ROUNDS} AS x FROM ({inner})"

    return f"""
WITH RECURSIVE sized AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b
  FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents)
),
start AS (
  SELECT CAST(doc_id AS VARCHAR) AS id_str, CAST(e.range AS INTEGER) AS epoch, n, a, b,
    row_number() OVER (PARTITION BY e.range ORDER BY doc_id) - 1 AS x
  FROM documents, range(2) e, sized
),
walk AS (
  {once("start")}
  UNION ALL
  {once("(SELECT * FROM walk WHERE x >= n)")}
)
SELECT id_str, epoch, CAST(x AS BIGINT) AS place FROM walk WHERE x < n"""


ORACLES["epoch_order"] = _epoch_oracle()


# --------------------------------------------------------------------------- k-means

_K, _ROUNDS, _SEED = 8, 3, 42


@query
def kmeans_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after drawing eight seeds and three rounds, and its distance."""
    rows = plan.stored(views.vectors(spark, sf_dir).select("vec_id", "vector"), "kmeans-rows")
    seeds = kmeans.draw_seeds(rows, "vec_id", "vector", _K, _SEED)
    found = kmeans.lloyd(rows, "vector", seeds, _ROUNDS)
    return kmeans.assign(found, rows, "vector").select("vec_id", "cluster", F.round("dist", 6).alias("dist"))


def _kmeans_oracle() -> str:
    def race(number: int) -> str:
        return f"-ln((CAST('0x' || substr(md5('{_SEED}:{number}:' || vec_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"

    chain = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
chosen0 AS MATERIALIZED (SELECT 0 AS cluster, e FROM v ORDER BY {race(0)}, vec_id LIMIT 1)"""
    for j in range(1, _K):
        chain += f""",
chosen{j} AS MATERIALIZED (SELECT * FROM chosen{j - 1} UNION ALL SELECT * FROM (SELECT {j} AS cluster, e FROM (
  SELECT vec_id, v.e, min(list_distance(v.e, c.e) ** 2) AS d FROM v, chosen{j - 1} c GROUP BY vec_id, v.e)
  WHERE d > 0 ORDER BY {race(j)} / d, vec_id LIMIT 1))"""
    chain += f""",
centres0 AS (SELECT * FROM chosen{_K - 1})"""
    for r in range(_ROUNDS):
        chain += f""",
nearest{r} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, arg_min(cluster, list_distance(v.e, c.e)) AS cluster
  FROM v, centres{r} c GROUP BY vec_id),
means{r} AS (SELECT cluster, i, avg(x) AS x FROM (
  SELECT cluster, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM nearest{r}) GROUP BY cluster, i),
centres{r + 1} AS MATERIALIZED (SELECT cluster, list(x ORDER BY i) AS e FROM means{r} GROUP BY cluster)"""
    return chain + f"""
SELECT vec_id, arg_min(cluster, list_distance(v.e, c.e)) AS cluster, round(min(list_distance(v.e, c.e)), 6) AS dist
FROM v, centres{_ROUNDS} c GROUP BY vec_id"""


ORACLES["kmeans_replay"] = _kmeans_oracle()


# -------------------------------------------------------- steps on given parameters


@query
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of the entries of all vectors, the matrix that principal components come from."""
    found = lsa.covariance(views.vectors(spark, sf_dir), "vector")
    return found.select("i", "j", F.round("value", 8).alias("value"))


ORACLES["covariance"] = """
WITH dims AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings
)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.v, b.v), 8) AS value
FROM dims a JOIN dims b ON a.vec_id = b.vec_id GROUP BY a.i, b.i"""

_CENTRES = 4


@query
def centre_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten heaviest terms of given centres, where a term's loading is its weight in each source."""
    _, table = _source_topics(spark, sf_dir)
    names = sorted(r["topic"] for r in table.select("topic").distinct().collect())
    cells = F.sort_array(F.collect_list(F.struct("topic", "weight")))
    basis = table.groupBy("term").agg(F.transform(cells, lambda c: c["weight"]).alias("loading"))
    given = [(c, [1.0 / (1 + abs(c - i)) for i in range(len(names))]) for c in range(_CENTRES)]
    centres = spark.createDataFrame(given, "cluster int, centre array<double>")
    found = cluster.cluster_top_terms(basis, centres)
    return found.select("cluster", "rank", "term", F.round("weight", 8).alias("weight"))


ORACLES["centre_terms"] = _topic_tables() + f"""
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(rank AS INTEGER) AS rank, term, round(weight, 8) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term) AS rank FROM (
    SELECT c.range AS cluster, p.term, sum(p.weight / (1 + abs(c.range - t.i))) AS weight
    FROM phi p JOIN (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS i FROM groups) t USING (topic), range({_CENTRES}) c
    GROUP BY c.range, p.term)) WHERE rank <= 10"""


@query
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of every post for given word vectors: length, vowels and whether it begins with t;
    words of three letters have none."""
    docs = plan.build_corpus(views.posts(spark, sf_dir).select("id_str", "tweet", "seq")).select(
        "id_str", text.split_words(F.col("clean")).alias("words")
    )
    word = F.col("word")
    numbers = [F.length(word), F.length(F.regexp_replace(word, "[^aeiou]", "")), word.startswith("t").cast("int")]
    known = docs.select(F.explode("words").alias("word")).distinct().filter(F.length("word") > 3)
    given = known.select("word", F.array(*[n.cast("double") for n in numbers]).alias("vector"))
    found = embed.document_vectors(plan.stored(given, "given-vectors"), docs)
    return found.select("id_str", *[F.round(F.get("vector", F.lit(i)), 8).alias(f"v{i}") for i in range(3)])


ORACLES["mean_vectors"] = _sql(
    "SELECT c.id_str, "
    + ", ".join(
        f"round(coalesce(sum(CASE WHEN length(word) > 3 THEN {value} ELSE 0 END)::DOUBLE / nullif(count(word), 0), 0.0), 8) AS v{i}"
        for i, value in enumerate(
            ["length(word)", "length(regexp_replace(word, '[^aeiou]', '', 'g'))", "CAST(starts_with(word, 't') AS INTEGER)"]
        )
    )
    + " FROM corpus c LEFT JOIN words w ON c.id_str = w.id_str GROUP BY c.id_str",
    "words",
)


# ---------------------------------------------------------------------------- ingest


@query
def stream_dedup_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `stream_ingest`, by a state bounded to a day instead of the table."""
    rows = views.news(spark, sf_dir)
    base = scratch_path(spark, "bounded")
    landing, table = f"{base}/landing", f"{base}/posts"
    first = views.status_lines(rows.filter(F.col("lang") == "en"))
    for lines in (first, views.status_lines(rows, extra_reposts=1)):
        lines.write.mode("append").text(landing)
        source = ingest.landed_stream(spark, landing)
        ingest.bounded_stream(source, table, f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(table).select("id_str", "tweet", "ctime", "rt_cnt")


ORACLES["stream_dedup_bounded"] = BASE_ORACLES["stream_ingest"]


def land_pages(lines: DataFrame, n_lines: int, path: str, per_page: int, pages_per_task: int = 100) -> None:
    """Write stored lines (at, seq, value), told apart by `at`, as files of `per_page` in order of `seq`;
    a task writes whole pages."""
    share = per_page * pages_per_task
    ones = lines.select("at", "seq", F.lit(1).cast("long").alias("one"))
    places = running_totals(ones, ["seq", "at"], ["one"]).select("at", F.col("one_before").alias("place"))
    task = F.floor(F.col("place") / share).cast("int")
    dealt = lines.join(places, "at").repartitionById(max(-(-n_lines // share), 1), task).sortWithinPartitions("place")
    dealt.select("value").write.mode("append").option("maxRecordsPerFile", per_page).text(path)


@query
def backfill_then_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English posts land as pages of 200 and are loaded page by page, some before a restart; then all
    posts come in live with other counts."""
    rows = views.news(spark, sf_dir)
    base = scratch_path(spark, "backfill")
    table, live = f"{base}/news", f"{base}/live"
    english = views.status_lines(rows.filter(F.col("lang") == "en"), keep=["seq"])
    english = english.withColumn("at", F.monotonically_increasing_id())
    in_half = [F.pmod(F.xxhash64("value"), F.lit(2)) == half for half in (0, 1)]
    english, n_lines = stored_with_counts(english, "english", {str(h): F.count_if(x) for h, x in enumerate(in_half)})
    for half in (0, 1):
        land_pages(english.filter(in_half[half]), n_lines[str(half)], f"{base}/pages", per_page=200)
        ingest.backfill_pages(spark, f"{base}/pages", table, f"{base}/pages-done", pages_per_load=8).awaitTermination()
    views.status_lines(rows, extra_reposts=1).write.text(live)
    source = ingest.landed_stream(spark, live)
    ingest.ingest_stream(source, table, f"{base}/live-done", available_now=True).awaitTermination()
    return news_source.read_news(spark, table).select("id_str", "tweet", "ctime", "rt_cnt")


ORACLES["backfill_then_live"] = BASE_ORACLES["stream_ingest"]


@query
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run, each taken on a pass that the run makes anyway: lines and rejects by reason,
    posts and empty ones after cleaning, distinct texts, texts without a row in the news table."""
    rows = views.news(spark, sf_dir)
    table = scratch_path(spark, "news")
    counts = ingest.ingest_batch(views.status_lines(rows), table, arrival=())
    posts = views.posts(spark, sf_dir).select("id_str", "tweet", "seq")
    cleaned, seen = stored_with_counts(
        clean_posts(posts), "cleaned", {"posts": F.count("*"), "empty posts": F.count_if(F.col("clean") == "")}
    )
    texts, distinct = stored_with_counts(distinct_texts(cleaned), "corpus", {"distinct texts": F.count("*")})
    _, misses = rank.fields_by_id(texts.select("id_str"), news_source.read_news(spark, table))
    return metric_rows(spark, counts | seen | distinct | {"texts without news": misses})


def _metrics_oracle() -> str:
    good = "event_type NOT IN ('error', 'signup')"
    counts = {
        "lines": "count(*) FROM news",
        "accepted": f"count(*) FROM news WHERE {good}",
        "rejected: not a JSON object": "count(*) FROM news WHERE event_type = 'error'",
        "rejected: not a status": "count(*) FROM news WHERE event_type = 'signup'",
        "rejected: missing field": "0",
        "rejected: no id": "0",
        "ids": f"count(DISTINCT id_str) FROM news WHERE {good}",
        "appended": f"count(DISTINCT id_str) FROM news WHERE {good}",
        "posts": "count(*) FROM cleaned",
        "empty posts": "count(*) FROM cleaned WHERE clean = ''",
        "distinct texts": "count(*) FROM corpus",
        "texts without news": "count(*) FROM corpus WHERE id_str NOT IN "
        f"(SELECT id_str FROM news WHERE {good})",
    }
    rows = [f"SELECT '{k}' AS metric, CAST(({f'SELECT {v}'}) AS BIGINT) AS value" for k, v in counts.items()]
    return _sql(" UNION ALL ".join(rows), "corpus", "news")


ORACLES["run_metrics"] = _metrics_oracle()
