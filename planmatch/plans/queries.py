"""Every operator on the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planmatch.functions.predicates import (
    UNLIMITED,
    Condition,
    close_to,
    conjunction,
    limited,
    normalise_category,
)
from planmatch.operators import chunking, relax_batch, retrieval, shaping, vector_index
from planmatch.operators import session_memory as memory
from planmatch.operators.relax import relax_single
from planmatch.plans import inputs, workload
from planmatch.plans.inputs import table
from planmatch.sources import catalog, documents, replies
from planmatch.sources.storage import scratch_path, spread
from planmatch.streaming.session_stream import run_to_end, turn_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register under the function's name; a leading `_` keeps operator names free."""
    QUERIES[run.__name__.lstrip("_")] = run
    return run


# ------------------------------------------------------------ sources, sinks


@query
def scan_catalog_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Names with quotes, commas, outer blanks and line breaks come back as they were."""
    part = table(spark, sf, "part").withColumn(
        "p_name", F.concat(F.lit(' a "'), "p_name", F.lit('",\nb, '), "p_name", F.lit(" "))
    )
    path = scratch_path(spark, "catalog")
    catalog.write_catalog(part, path)
    return catalog.read_catalog(spark, path, part.schema, multi_line=True)


@query
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    separator = "\x1e"
    documents.write_documents(
        table(spark, sf, "documents"), "text", ["lang", "source"], path, separator
    )
    read = documents.read_documents(spark, path, separator)
    folder = [
        F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name) for name in ("lang", "source")
    ]
    return (
        read.select(*folder, F.length("text").alias("length"))
        .groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    )


@query
def classifier_response(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    ranked = relax_batch.rank_relevance(inputs.relevance(customer))
    best_first = F.reverse(F.array_sort(F.collect_list(F.struct("rk", "col", "score"))))
    grouped = ranked.groupBy("request_id").agg(best_first.alias("r"))
    reply = F.to_json(
        F.array(
            F.struct(
                F.transform("r", lambda x: x["col"]).alias("labels"),
                F.transform("r", lambda x: x["score"]).alias("scores"),
            )
        )
    )
    return replies.classifier_relevance(
        grouped.select("request_id", reply.alias("reply")), "reply"
    )


PLAN_COLUMNS = ("p_brand", "p_type", "p_size", "p_retailprice")
BODY_SCHEMA = T.StructType(
    [
        T.StructField("User query", T.StringType()),
        T.StructField("SQL queries", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("stored_weights", T.ArrayType(T.DoubleType())),
        T.StructField("Final Queries", T.ArrayType(T.StringType())),
        T.StructField(
            "plans",
            T.ArrayType(
                T.StructType(
                    [T.StructField(c, T.MapType(T.StringType(), T.StringType())) for c in PLAN_COLUMNS]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)


def answer_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from requests to JSON answers, for every customer. One in fifty asks
    for a type of at least something, which no text column has."""
    customer = table(spark, sf, "customer")
    requests, relevance = inputs.requests(customer), inputs.relevance(customer)
    ill_typed = (F.col("request_id") % 50 == 0) & (F.col("col") == "p_type")
    valid, errors = relax_batch.split_requests(
        inputs.constraints(customer).withColumn("op", F.when(ill_typed, ">=").otherwise(F.col("op"))),
        inputs.CATALOG_COLUMNS, table(spark, sf, "part").schema
    )
    answers = _relaxed(spark, sf, valid)
    kept = relax_batch.drop_conditions(valid, relax_batch.dropped_columns(relevance, answers))
    rows = answers.select("request_id", F.inline("rows"))
    maps = shaping.rows_to_column_map(rows, ["request_id"], "p_partkey", PLAN_COLUMNS)
    plans = maps.select("request_id", F.struct(*PLAN_COLUMNS).alias("plans"))
    labels = relax_batch.rank_relevance(relevance).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rk", "col", "score"))).alias("ranked")
    )
    sql = relax_batch.render_queries(valid).withColumnRenamed("query", "sql")
    final = relax_batch.render_queries(kept).withColumnRenamed("query", "final_query")
    joined = requests
    for part in (sql, final, plans, labels, errors):
        joined = joined.join(part, "request_id", "left")
    return shaping.result_envelope(
        joined.select(
            "request_id",
            "query",
            F.coalesce("sql", F.lit("")).alias("sql"),
            F.transform("ranked", lambda x: x["col"]).alias("labels"),
            F.transform("ranked", lambda x: x["score"]).alias("stored_weights"),
            F.coalesce("final_query", F.lit("")).alias("final_query"),
            "plans",
            "error",
        )
    )


@query
def result_envelope(spark: SparkSession, sf: str) -> DataFrame:
    body = F.from_json("body", BODY_SCHEMA)
    parsed = chunking.pin(answer_envelopes(spark, sf), b=body)
    plan = F.get("b.plans", F.lit(0))
    return parsed.select(
        "request_id",
        "status",
        F.col("b").getField("User query").alias("user_query"),
        F.col("b").getField("SQL queries").alias("sql_query"),
        F.get(F.col("b").getField("Final Queries"), F.lit(0)).alias("final_query"),
        F.concat_ws(",", "b.labels").alias("labels"),
        F.concat_ws(",", F.transform("b.stored_weights", lambda w: w.cast("string"))).alias("weights"),
        F.concat_ws(",", F.map_keys(plan["p_brand"])).alias("plan_keys"),
        *[F.concat_ws(",", F.map_values(plan[c])).alias(f"plan_{c}") for c in PLAN_COLUMNS],
        "b.error",
    )


# ------------------------------------------------- projection and predicates


@query
def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    conds = [
        Condition("p_type", "=", "ECONOMY"),
        Condition("p_size", "<=", 20),
        Condition("p_retailprice", "<=", 950.0),
    ]
    return table(spark, sf, "part").where(conjunction(conds))


@query
def predicate_ops(spark: SparkSession, sf: str) -> DataFrame:
    conds = [
        Condition("l_linestatus", "=", "F"),
        Condition("l_discount", ">=", 0.02),
        Condition("l_tax", "<=", 0.06),
        Condition("l_extendedprice", "<", 60000.0),
        Condition("l_linenumber", ">", 1),
        Condition("l_quantity", "between", (10, 30)),
        Condition("l_returnflag", "in", ("A", "R")),
    ]
    return (
        table(spark, sf, "lineitem")
        .where(conjunction(conds))
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    )


@query
def fuzzy_category(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.where(close_to(F.col("p_type"), " Economic ") | close_to(F.col("p_name"), "WIDGE")).select(
        "p_partkey", "p_type", "p_name"
    )


@query
def normalize_category(spark: SparkSession, sf: str) -> DataFrame:
    messy = table(spark, sf, "part").select(
        F.concat(F.lit("  "), F.upper("p_name"), F.lit("   Add \t On "), "p_type", F.lit(" ")).alias("c")
    )
    return (
        messy.select(normalise_category(F.col("c")).alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _with_unlimited(part: DataFrame) -> DataFrame:
    """Sizes from 40 on stand for unlimited minutes."""
    minutes = F.when(F.col("p_size") >= 40, F.lit(UNLIMITED[0])).otherwise(F.col("p_size"))
    return part.withColumn("minutes", minutes)


@query
def unlimited_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    part = _with_unlimited(table(spark, sf, "part"))
    minutes = F.col("minutes")
    return part.groupBy("p_brand").agg(
        F.round(F.avg(limited(minutes)), 6).alias("average"),
        F.count_if(minutes.isin(list(UNLIMITED))).alias("n_unlimited"),
        F.count_if(minutes >= 30).alias("n_at_least_30"),
    )


@query
def project_requested(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.project_requested(
        table(spark, sf, "part"), ["p_brand", "p_size"], ["p_partkey", "p_brand"]
    )


@query
def project_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.project_requested(table(spark, sf, "part"), ["p_brand", "p_color"], ["p_partkey"])


@query
def parse_column_list(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in five manners of writing, one per market segment."""
    customer = table(spark, sf, "customer")
    name = F.col("c_name")
    manners = {
        "AUTOMOBILE": F.concat(F.lit("Cols for "), name, F.lit(": ['p_brand', 'p_size']")),
        "BUILDING": F.concat(F.lit("see [1] then [\"p_type\",'"), name, F.lit("'] ok")),
        "FURNITURE": F.concat(F.lit("[['"), name, F.lit("','m']]")),
        "HOUSEHOLD": F.concat(F.lit("none for "), name),
        "MACHINERY": F.concat(F.lit("] then ["), name),
    }
    reply = F.lit(None).cast("string")
    for segment, text in manners.items():
        reply = F.when(F.col("c_mktsegment") == segment, text).otherwise(reply)
    parsed = replies.column_lists(customer.select("c_custkey", reply.alias("reply")), "reply", "c_custkey")
    return parsed.select(
        "request_id",
        "slice",
        F.concat_ws("|", "names").alias("names"),
        F.coalesce(F.size("names"), F.lit(-1)).alias("n_names"),
        "bad",
    )


@query
def missing_reply(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn")
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), "text"
    )
    return asked.join(answers, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", shaping.or_nothing_found(F.col("text")).alias("reply")
    )


# ---------------------------------------------------------------- relaxation

# The flagship request. No part is TINY, so that wish is given up.
FLAGSHIP = (Condition("p_type", "=", "TINY"), Condition("p_brand", "=", "Brand#7"))
FLAGSHIP_LABELS = ("p_type", "p_brand")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    found = relax_single(table(spark, sf, "part"), FLAGSHIP, FLAGSHIP_LABELS)
    shaped = shaping.project_requested(
        found.rows, FLAGSHIP_LABELS, ["p_partkey", "p_name", "p_retailprice"]
    )
    return shaping.top_rows(shaped, 3, "p_retailprice", "p_partkey").withColumn(
        "level", F.lit(found.level)
    )


@query
def _relax_single(spark: SparkSession, sf: str) -> DataFrame:
    found = relax_single(inputs.catalog(spark, sf), FLAGSHIP, FLAGSHIP_LABELS)
    return found.rows.withColumn("level", F.lit(found.level))


def _relaxed(spark: SparkSession, sf: str, constraints: DataFrame | None = None) -> DataFrame:
    customer = table(spark, sf, "customer")
    if constraints is None:
        constraints = inputs.constraints(customer)
    return relax_batch.relax_batch(
        inputs.catalog(spark, sf),
        inputs.requests(customer),
        constraints,
        inputs.relevance(customer),
        key="p_partkey",
        price="p_retailprice",
        payload=["p_brand", "p_type", "p_size"],
    )


@query
def _relax_batch(spark: SparkSession, sf: str) -> DataFrame:
    return relax_batch.batch_rows(_relaxed(spark, sf))


@query
def relax_batch_close(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests with misspelt types."""
    misspelt = inputs.constraints(table(spark, sf, "customer"), close=True)
    return relax_batch.batch_rows(_relaxed(spark, sf, misspelt))


@query
def relax_batch_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Five numeric columns and two flags constrained together, on all order lines."""
    supplier = table(spark, sf, "supplier")
    answers = relax_batch.relax_batch(
        inputs.line_catalog(spark, sf),
        supplier.select(F.col("s_suppkey").alias("request_id")),
        inputs.wide_constraints(supplier),
        inputs.wide_relevance(supplier),
        key="l_key",
        price="l_extendedprice",
        payload=["l_quantity", "l_linestatus"],
    )
    return relax_batch.batch_rows(answers)


@query
def relax_batch_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of dates and of texts, on all orders."""
    supplier = table(spark, sf, "supplier")
    valid, _ = relax_batch.split_requests(
        inputs.order_constraints(supplier), inputs.ORDER_LABELS, table(spark, sf, "orders").schema, text_ranges=True
    )
    answers = relax_batch.relax_batch(
        table(spark, sf, "orders"),
        supplier.select(F.col("s_suppkey").alias("request_id")),
        valid,
        inputs.order_relevance(supplier),
        key="o_orderkey",
        price="o_totalprice",
        payload=["o_orderpriority"],
    )
    return relax_batch.batch_rows(answers)


@query
def relax_batch_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Wishes for a type, whatever its case and blanks."""
    customer = table(spark, sf, "customer")
    answers = relax_batch.relax_batch(
        inputs.untidy_catalog(spark, sf),
        inputs.requests(customer),
        inputs.constraints(customer).where(F.col("col").isin("p_type", "p_brand")),
        inputs.relevance(customer),
        key="p_partkey",
        price="p_retailprice",
        payload=["p_brand", "p_type"],
        folded=["p_type"],
    )
    return relax_batch.batch_rows(answers)


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return relax_batch.relax_levels(
        inputs.catalog(spark, sf),
        inputs.requests(customer),
        inputs.constraints(customer),
        inputs.relevance(customer),
    )


@query
def relax_level(spark: SparkSession, sf: str) -> DataFrame:
    relevance = inputs.relevance(table(spark, sf, "customer"))
    return relax_batch.batch_levels(_levels(spark, sf), relevance).drop("is_empty")


@query
def is_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("request_id", "is_empty")


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions left at the level that each request reached."""
    customer = table(spark, sf, "customer")
    dropped = relax_batch.dropped_columns(inputs.relevance(customer), _levels(spark, sf))
    return relax_batch.drop_conditions(inputs.constraints(customer), dropped)


@query
def drop_conditions_on(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf).select(
        "request_id", "ord", "col", "op", F.get("values", F.lit(0)).alias("value")
    )


@query
def render_final_query(spark: SparkSession, sf: str) -> DataFrame:
    return relax_batch.render_queries(_kept(spark, sf)).withColumnRenamed("query", "final_query")


@query
def rank_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return relax_batch.rank_relevance(inputs.relevance(table(spark, sf, "customer")))


@query
def score_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a request, the ten label means as column descriptions."""
    vectors = table(spark, sf, "embeddings")
    scores = retrieval.score_all(
        vectors,
        retrieval.centroids(vectors, "label", "embedding"),
        "vec_id",
        "embedding",
        "label",
        "embedding",
    )
    return scores.withColumn("score", F.round("score", 6))


# ------------------------------------------------------- sort, limit, shaping


@query
def sort_by_price(spark: SparkSession, sf: str) -> DataFrame:
    part = shaping.project_requested(
        table(spark, sf, "part"), ["p_brand"], ["p_partkey", "p_retailprice"]
    )
    return shaping.sort_by_price(part, "p_retailprice", "p_partkey")


@query
def top3(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.top_rows(table(spark, sf, "part"), 3, "p_retailprice", "p_partkey")


@query
def rows_to_column_map(spark: SparkSession, sf: str) -> DataFrame:
    best = shaping.top_rows_by(
        table(spark, sf, "part"), ["p_brand"], 3, "p_retailprice", "p_partkey"
    )
    columns = ["p_name", "p_type", "p_retailprice"]
    maps = shaping.rows_to_column_map(best, ["p_brand"], "p_partkey", columns)
    entries = inputs.union_all(
        [
            maps.select(
                "p_brand",
                F.lit(c).alias("column_name"),
                F.posexplode(F.map_entries(c)).alias("place", "e"),
            ).select(
                "p_brand",
                "column_name",
                "place",
                F.col("e.key").alias("row_key"),
                F.col("e.value").cast("string").alias("value"),
            )
            for c in columns
        ]
    )
    return entries


# ------------------------------------------------------------ text, retrieval


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


@query
def chunk_static(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_static(_documents(spark, sf), 512, 20)


@query
def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_sentences(_documents(spark, sf), 100, 20)


@query
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_semantic(_documents(spark, sf), 95.0, 1)


@query
def chunk_guarded_doc(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_guarded(_documents(spark, sf), 200)


@query
def chunk_guarded_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One batch per source."""
    return chunking.chunk_guarded(_documents(spark, sf), 400, batch="source")


def _nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return retrieval.cosine_topk(
        vectors,
        retrieval.centroids(vectors, "label", "embedding"),
        k,
        "vec_id",
        "embedding",
        "label",
        "embedding",
    )


@query
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 5).withColumn("score", F.round("score", 6))


@query
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return retrieval.ann_topk(
        vectors,
        retrieval.centroids(vectors, "label", "embedding"),
        5,
        "vec_id",
        "embedding",
        "label",
        "embedding",
    )


@query
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Per question how many rows the approximate search found, and whether it reached nine
    tenths of the exact ones."""
    exact, near = _nearest(spark, sf, 5), ann_topk(spark, sf)
    found = near.groupBy("label").agg(F.count(F.lit(1)).alias("n_found"))
    hits = exact.join(near, ["label", "vec_id"], "left_semi").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_hit")
    )
    total = exact.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return (
        total.join(found, "label", "left")
        .join(hits, "label", "left")
        .select(
            "label",
            F.coalesce("n_found", F.lit(0)).alias("n_found"),
            (10 * F.coalesce("n_hit", F.lit(0)) >= 9 * F.col("n")).alias("reached"),
        )
    )


@query
def index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector asks an inverted file of all: rows found, and whether they
    are nine tenths of the exact ones."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").alias("asked_id"), F.col("embedding").alias("asked")
    )
    index = vector_index.build_index(vectors, "vec_id", "embedding", k=10)
    near = vector_index.search_index(index, asked, 10, "asked_id", "asked")
    exact = retrieval.cosine_topk(vectors, asked, 10, "vec_id", "embedding", "asked_id", "asked")
    both = exact.select("asked_id", "vec_id", F.lit(1).alias("wanted")).join(
        near.select("asked_id", "vec_id", F.lit(1).alias("found")), ["asked_id", "vec_id"], "full"
    )
    return both.agg(
        F.count("found").alias("n_found"),
        (10 * F.count(F.when(F.col("wanted").isNotNull(), F.col("found"))) >= 9 * F.count("wanted")).alias("reached"),
    )


@query
def assemble_context(spark: SparkSession, sf: str) -> DataFrame:
    """A question per label; the text of a vector is the document of the same number."""
    nearest = _nearest(spark, sf, 5)
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    questions = table(spark, sf, "embeddings").select("label").distinct().withColumn(
        "question", F.concat(F.lit("What is said about topic "), F.col("label").cast("string"), F.lit("?"))
    )
    return retrieval.assemble_context(
        retrieval.attach_texts(nearest, texts, "vec_id"), questions, "label", "question", "text"
    )


# ------------------------------------------------------------- session memory


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    return memory.number_turns(turns.select("conv_id", "turn", "text"))


def _session(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(weights, levels) of all user turns; the level stands for the relaxation reached."""
    turns = user_turns(spark, sf)
    numbered = turns.select("conv_id", F.col("turn_no").alias("turn"), "text")
    weights = inputs.turn_weights(numbered).withColumnRenamed("turn", "turn_no")
    levels = turns.select("conv_id", "turn_no", (F.length("text") % 4).alias("level"))
    return weights, levels


EVERY_TURN = ("conv_id", "turn_no")


def _every_turn(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(current, stored, turns, ordered) of every turn of every conversation."""
    current, levels = _session(spark, sf)
    history = memory.session_history(current, levels)
    # The state after the last turn waits for a turn that has not come.
    stored = memory.stored_weights(history).join(levels.select(*EVERY_TURN), list(EVERY_TURN), "left_semi")
    turns = levels.select(*EVERY_TURN, F.col("turn_no").alias("chat_length"), "level")
    merged = memory.merge_weights(current, stored, EVERY_TURN)
    return current, stored, turns, memory.order_weights(merged, EVERY_TURN)


@query
def merge_weights(spark: SparkSession, sf: str) -> DataFrame:
    current, stored, _, _ = _every_turn(spark, sf)
    merged = memory.merge_weights(current, stored, EVERY_TURN)
    return merged.withColumn("weight", F.round("weight", 6))


@query
def order_weights(spark: SparkSession, sf: str) -> DataFrame:
    *_, ordered = _every_turn(spark, sf)
    return ordered.withColumn("weight", F.round("weight", 6))


@query
def memory_point(spark: SparkSession, sf: str) -> DataFrame:
    *_, turns, ordered = _every_turn(spark, sf)
    return memory.memory_point(ordered, turns, EVERY_TURN)


@query
def truncate_memory(spark: SparkSession, sf: str) -> DataFrame:
    *_, turns, ordered = _every_turn(spark, sf)
    point = memory.memory_point(ordered, turns, EVERY_TURN)
    kept = memory.truncate_memory(ordered, point, turns, EVERY_TURN)
    return kept.withColumn("weight", F.round("weight", 6))


@query
def remembered_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """A turn asks for one condition per label it weighs."""
    current, _, turns, ordered = _every_turn(spark, sf)
    asked = current.select(*EVERY_TURN, F.col("label").alias("col"), F.col("weight").alias("value"))
    point = memory.memory_point(ordered, turns, EVERY_TURN)
    return memory.remembered_conditions(asked, ordered, point, EVERY_TURN)


@query
def session_fold(spark: SparkSession, sf: str) -> DataFrame:
    states = memory.session_fold(*_session(spark, sf))
    return memory.state_rows(states).withColumn("weight", F.round("weight", 6))


@query
def session_stream(spark: SparkSession, sf: str) -> DataFrame:
    records = turn_records(*_session(spark, sf))
    path = scratch_path(spark, "turns")
    records.write.parquet(path)
    turns = spark.readStream.schema(records.schema).parquet(path)
    states = run_to_end(
        turns, scratch_path(spark, "stream-checkpoint"), scratch_path(spark, "stream-states")
    )
    return memory.state_rows(states).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------- question workload


@query
def q_match(spark: SparkSession, sf: str) -> DataFrame:
    conds = [
        Condition("p_type", "=", "PROMO"),
        Condition("p_brand", "=", "Brand#3"),
        Condition("p_size", "<=", 0),
    ]
    return workload.match(table(spark, sf, "part"), conds, ["p_size", "p_type", "p_brand"])


@query
def q_argmax_count(spark: SparkSession, sf: str) -> DataFrame:
    top = workload.largest_group(table(spark, sf, "customer"), "c_nationkey")
    nation = table(spark, sf, "nation")
    return top.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query
def q_count_where(spark: SparkSession, sf: str) -> DataFrame:
    return workload.count_where(table(spark, sf, "part"), [Condition("p_type", "=", "SMALL")])


@query
def q_argmin_group(spark: SparkSession, sf: str) -> DataFrame:
    return workload.area_of_cheapest(
        table(spark, sf, "part"),
        [Condition("p_type", "=", "ECONOMY")],
        "p_brand",
        "p_retailprice",
        "p_partkey",
    )


@query
def q_avg_where(spark: SparkSession, sf: str) -> DataFrame:
    return workload.average_where(
        table(spark, sf, "orders"),
        [Condition("o_totalprice", ">=", 100000.0)],
        "o_orderpriority",
        "o_totalprice",
    )


@query
def q_budget_near(spark: SparkSession, sf: str) -> DataFrame:
    spread = workload.budget_near(
        table(spark, sf, "customer"),
        table(spark, sf, "nation"),
        "NATION_3",
        "c_acctbal",
        "n_nationkey",
        "c_nationkey",
        "n_name",
        "n_regionkey",
    )
    return spread.select(*[F.round(c, 6).alias(c) for c in ("low", "q25", "median", "q75", "high")])


@query
def q_rank_price(spark: SparkSession, sf: str) -> DataFrame:
    return workload.rank_by_price(table(spark, sf, "part"), "p_retailprice", "p_partkey")


@query
def q_bounded_has_all(spark: SparkSession, sf: str) -> DataFrame:
    return workload.bounded_with_all(
        table(spark, sf, "part"),
        Condition("p_size", "<=", 30),
        F.split("p_name", " "),
        ["red", "widget"],
    )


@query
def q_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return workload.correlation(table(spark, sf, "part"), "p_size", "p_retailprice")


@query
def q_argmax_excluding(spark: SparkSession, sf: str) -> DataFrame:
    return workload.largest_modest_group(
        table(spark, sf, "part"), "p_brand", "p_retailprice", [Condition("p_type", "=", "ECONOMY")]
    )


@query
def q_budget_unlimited(spark: SparkSession, sf: str) -> DataFrame:
    part = _with_unlimited(table(spark, sf, "part"))
    return workload.within_budget_unlimited(
        part, "p_retailprice", 950.0, "minutes", "p_size", 20
    ).select("p_partkey", "p_retailprice", "minutes")


@query
def q_at_least(spark: SparkSession, sf: str) -> DataFrame:
    return workload.at_least(
        table(spark, sf, "lineitem"),
        "l_quantity",
        30,
        ["l_orderkey", "l_linenumber", "l_extendedprice"],
    )
