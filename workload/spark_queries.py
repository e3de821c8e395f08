"""One query per operator of the inventory, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators import (
    cleaning,
    collaborative,
    history,
    hybrid,
    metadata,
    popularity,
    ranking,
    ratings,
    similarity,
    tfidf,
)
from cartwise.plans import serving, training
from cartwise.schema import EVENT_COLUMNS, KEYED_EVENTS
from cartwise.session import materialise, scratch_path
from cartwise.sources import messages, tables
from cartwise.streaming import dedupe, ingest
from cartwise.streaming import popularity as streaming_popularity
from workload import views
from workload.views import AS_OF, catalog, interactions, purchase_log, readable_time, scored_log, shop_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


# Sources and sinks


def _text_times(events: DataFrame) -> DataFrame:
    zoned = F.concat(F.date_format("event_time", views.TIME_FORMAT), F.lit(" UTC"))
    return events.withColumn("event_time", zoned)


@query
def scan_events(spark, sf_dir):
    path = tables.write_csv(_text_times(shop_events(spark, sf_dir)), scratch_path(spark, "events-csv"))
    return readable_time(tables.read_events(spark, path, "csv", KEYED_EVENTS))


@query
def scan_events_csv_inferred(spark, sf_dir):
    path = tables.write_csv(shop_events(spark, sf_dir).drop("event_time"), scratch_path(spark, "inferred-csv"))
    table = tables.read_inferred_csv(spark, path)
    whole = [f.name for f in table.schema if f.dataType.typeName() == "integer"]
    return table.withColumns({c: F.col(c).cast("long") for c in whole})


@query
def scan_events_timestamps(spark, sf_dir):
    path = tables.write_csv(_text_times(shop_events(spark, sf_dir)), scratch_path(spark, "times-csv"))
    events = tables.read_events(spark, path, "csv", KEYED_EVENTS)
    return events.select(
        "event_id",
        F.date_format("event_time", views.TIME_FORMAT).alias("event_time"),
        F.unix_micros("event_time").alias("epoch_micros"),
    )


@query
def recs_roundtrip(spark, sf_dir):
    recs = hybrid.recommendations_for(scored_log(spark, sf_dir))
    path = scratch_path(spark, "recs")
    tables.write_recommendations(recs, path, buckets=8)
    return _rounded(tables.read_recommendations(spark, path), "final_score")


@query
def sink_csv_roundtrip(spark, sf_dir):
    recs = hybrid.recommendations_for(scored_log(spark, sf_dir))
    path = tables.write_csv(recs, scratch_path(spark, "recs-csv"))
    return _rounded(tables.read_recommendations(spark, path, "csv"), "final_score")


@query
def sink_parquet_roundtrip(spark, sf_dir):
    path = tables.write_parquet(catalog(spark, sf_dir), scratch_path(spark, "catalog"))
    return _rounded(tables.read_table(spark, path), "price")


@query
def events_json_roundtrip(spark, sf_dir):
    sent = messages.to_messages(_text_times(shop_events(spark, sf_dir)))
    path = scratch_path(spark, "json")
    sent.write.text(path)
    decoded = ingest.decode(tables.read_table(spark, path, "text"), KEYED_EVENTS)
    return readable_time(ingest.good_events(decoded, KEYED_EVENTS))


# Cleaning


@query
def clean_fill(spark, sf_dir):
    return readable_time(cleaning.fill_missing(shop_events(spark, sf_dir)))


@query
def clean_dropna_any(spark, sf_dir):
    return readable_time(cleaning.drop_incomplete(shop_events(spark, sf_dir)))


@query
def clean_dropna_subset(spark, sf_dir):
    return readable_time(cleaning.drop_incomplete(shop_events(spark, sf_dir), ["category_code", "brand"]))


@query
def dedupe_rows(spark, sf_dir):
    return cleaning.distinct_rows(shop_events(spark, sf_dir).select("product_id", "event_type", "brand", "user_id"))


@query
def cap_rows(spark, sf_dir):
    log = purchase_log(spark, sf_dir)
    order = ["event_time", "order_id", "line", "user_id", "product_id", "event_type", "price"]
    return readable_time(cleaning.first_rows(log, 20000, order))


@query
def rating_events(spark, sf_dir):
    return ratings.rate_events(interactions(spark, sf_dir)).select("event_id", "event_type", "rating")


# Popular and trending


@query
def event_pivot(spark, sf_dir):
    types = ["view", "cart", "purchase", "signup", "error"]
    return popularity.count_by_type(interactions(spark, sf_dir), types)


@query
def popularity_scores(spark, sf_dir):
    return popularity.popularity_scores(interactions(spark, sf_dir))


@query
def trending_scores(spark, sf_dir):
    return popularity.trending_scores(interactions(spark, sf_dir))


@query
def popular_purchases(spark, sf_dir):
    return popularity.popular_items(purchase_log(spark, sf_dir))


@query
def trending_items(spark, sf_dir):
    return popularity.trending_items(interactions(spark, sf_dir), as_of=AS_OF)


@query
def trending_items_fortnight(spark, sf_dir):
    return popularity.trending_items(interactions(spark, sf_dir), top_k_items=None, days=14, as_of=AS_OF)


@query
def trending_items_untimed(spark, sf_dir):
    return popularity.trending_items(interactions(spark, sf_dir), days=None)


@query
def trending_and_popular(spark, sf_dir):
    return popularity.trending_and_popular(interactions(spark, sf_dir), as_of=AS_OF)


@query
def union_sources(spark, sf_dir):
    events = interactions(spark, sf_dir)
    return popularity.union_lists(
        popularity.trending_items(events, as_of=AS_OF), popularity.popular_items(events)
    )


@query
def dedupe_by_priority(spark, sf_dir):
    events = interactions(spark, sf_dir)
    return popularity.first_source_wins(
        popularity.trending_items(events, as_of=AS_OF), popularity.popular_items(events)
    )


@query
def seeded_sample(spark, sf_dir):
    return popularity.seeded_sample(popularity.popular_items(interactions(spark, sf_dir)), 5, seed=42)


@query
def diversified_items(spark, sf_dir):
    return popularity.diversified_items(interactions(spark, sf_dir), seed=7, as_of=AS_OF)


# Ratings


@query
def user_index(spark, sf_dir):
    return ratings.dense_index(purchase_log(spark, sf_dir), "user_id", "user_index")


@query
def product_index(spark, sf_dir):
    return ratings.dense_index(purchase_log(spark, sf_dir), "product_id", "product_index")


@query
def catalog_counts(spark, sf_dir):
    return ratings.catalog_counts(purchase_log(spark, sf_dir))


def _matrix(df: DataFrame) -> DataFrame:
    whole = {c: F.col(c).cast("long") for c in ("user_index", "product_index")}
    return _rounded(df.withColumns(whole), "rating")


@query
def ratings_matrix(spark, sf_dir):
    return _matrix(ratings.rating_matrix(shop_events(spark, sf_dir))[0])


@query
def ratings_matrix_summed(spark, sf_dir):
    return _matrix(ratings.rating_matrix(purchase_log(spark, sf_dir), aggregate="sum")[0])


@query
def train_test_split(spark, sf_dir):
    train, test = ratings.split_rows(interactions(spark, sf_dir).select("event_id"), ["event_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def rating_rmse(spark, sf_dir):
    rated = ratings.rate_events(interactions(spark, sf_dir))
    train, test = ratings.split_rows(rated, ["event_id"])
    mean = train.select(F.avg("rating")).scalar()
    return _rounded(collaborative.rmse(test.withColumn("prediction", mean)), "rmse")


# Text and similarity


@query
def product_tokens(spark, sf_dir):
    return tfidf.term_positions(tfidf.with_terms(catalog(spark, sf_dir), stop_words=True))


@query
def product_tokens_filtered(spark, sf_dir):
    return tfidf.term_positions(tfidf.with_terms(catalog(spark, sf_dir)))


@query
def event_product_tokens(spark, sf_dir):
    return tfidf.term_positions(tfidf.with_terms(tfidf.product_documents(shop_events(spark, sf_dir))))


def _term_counts(spark, sf_dir):
    documents = catalog(spark, sf_dir)
    return documents, tfidf.term_frequency(tfidf.with_terms(documents))


@query
def term_frequency(spark, sf_dir):
    return _term_counts(spark, sf_dir)[1]


@query
def term_document_frequency(spark, sf_dir):
    return tfidf.document_frequency(_term_counts(spark, sf_dir)[1])


def _weights(spark, sf_dir):
    documents, tf = _term_counts(spark, sf_dir)
    return tfidf.tfidf(tf, tfidf.document_frequency(tf), documents).select("product_id", "term", "w")


@query
def tfidf_weights(spark, sf_dir):
    return _rounded(_weights(spark, sf_dir), "w")


@query
def tfidf_normalised(spark, sf_dir):
    return _rounded(tfidf.l2_normalise(_weights(spark, sf_dir)), "w")


@query
def item_similarity(spark, sf_dir):
    return similarity.item_similarity(catalog(spark, sf_dir))


@query
def item_similarity_event_idf(spark, sf_dir):
    events = shop_events(spark, sf_dir)
    documents = tfidf.product_documents(events)
    return similarity.item_similarity(documents, events=events)


@query
def similar_items(spark, sf_dir):
    return similarity.similar_items(catalog(spark, sf_dir))


@query
def similar_items_later(spark, sf_dir):
    return similarity.later_similar_items(catalog(spark, sf_dir))


@query
def similar_items_nested(spark, sf_dir):
    nested = similarity.nest_neighbours(similarity.similar_items(catalog(spark, sf_dir)))
    ids = F.array_join(F.transform("recommendations", lambda r: r["j"].cast("string")), ",")
    return nested.select(F.col("i").alias("product_id"), ids.alias("neighbours"))


@query
def explode_neighbours(spark, sf_dir):
    nested = similarity.nest_neighbours(similarity.later_similar_items(catalog(spark, sf_dir)))
    return similarity.content_scores(nested)


# Hybrid scores and ranks


def _hybrid(spark, sf_dir):
    neighbours = similarity.later_similar_items(catalog(spark, sf_dir))
    content = similarity.content_scores(similarity.nest_neighbours(neighbours))
    return hybrid.hybrid_scores(views.cf_standin(purchase_log(spark, sf_dir)), content)


@query
def hybrid_scores(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("user_id", "product_id", "recommended_product", "final_score")


@query
def hybrid_best(spark, sf_dir):
    neighbours = similarity.later_similar_items(catalog(spark, sf_dir))
    content = similarity.content_scores(similarity.nest_neighbours(neighbours))
    return _rounded(hybrid.best_hybrid(views.cf_standin(purchase_log(spark, sf_dir)), content), "final_score")


@query
def dedupe_across_users(spark, sf_dir):
    return ranking.dedupe_across_users(views.standin_scores(spark, sf_dir))


@query
def rank_per_user(spark, sf_dir):
    return ranking.number_rows(views.standin_scores(spark, sf_dir), hybrid.best_first(), per=["user_id"])


@query
def best_per_user_product(spark, sf_dir):
    usable = scored_log(spark, sf_dir).where(F.col("final_score").isNotNull() & ~F.isnan("final_score"))
    return _rounded(ranking.best_per_key(usable, ["user_id", "product_id"], "final_score"), "final_score")


@query
def topk_per_user(spark, sf_dir):
    return _rounded(hybrid.top_per_user(views.standin_scores(spark, sf_dir)), "final_score")


@query
def recs_for_user(spark, sf_dir):
    request = views.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    wanted = request.select(F.col("c_custkey").alias("user_id"))
    return _rounded(hybrid.recommendations_for(scored_log(spark, sf_dir), wanted), "final_score")


# Collaborative filtering: the models' own numbers are not SQL; what must hold of them is


def _als_parts(spark, sf_dir):
    matrix, user_ids, product_ids = ratings.rating_matrix(cleaning.fill_missing(shop_events(spark, sf_dir)))
    train, test = ratings.split_rows(materialise(matrix), ["user_index", "product_index", "rating"])
    return train, test, user_ids, product_ids


@query
def als_predictions(spark, sf_dir):
    train, test, _, _ = _als_parts(spark, sf_dir)
    return collaborative.fit_als(train, blocks=2).transform(test)


@query
def als_cv_metrics(spark, sf_dir):
    train, _, _, _ = _als_parts(spark, sf_dir)
    return collaborative.cross_validate_als(train, blocks=2)[1]


@query
def cf_recommendations(spark, sf_dir):
    train, _, user_ids, product_ids = _als_parts(spark, sf_dir)
    return collaborative.recommend_from_model(collaborative.fit_als(train, blocks=2), user_ids, product_ids)


@query
def als_normal_equations(spark, sf_dir):
    train, _, user_ids, _ = _als_parts(spark, sf_dir)
    solved = collaborative.normal_equations(collaborative.fit_als(train, blocks=2), train)
    return solved.join(user_ids, "user_index").select("user_id", "n_ratings", (F.col("residual") < 1e-3).alias("solved"))


@query
def als_scored_rows(spark, sf_dir):
    train, test, _, _ = _als_parts(spark, sf_dir)
    model = collaborative.fit_als(train, blocks=2)
    factors = [
        table.select(F.col("id").alias(key), F.col("features").alias(name))
        for table, key, name in ((model.userFactors, "user_index", "u"), (model.itemFactors, "product_index", "v"))
    ]
    scored = model.transform(test).join(factors[0], "user_index").join(factors[1], "product_index")
    product = F.aggregate(F.zip_with("u", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x)
    agrees = F.abs(F.col("prediction") - product) < 1e-4
    return _matrix(scored.select("user_index", "product_index", "rating", agrees.alias("agrees")))


@query
def als_fold_facts(spark, sf_dir):
    train, _, _, _ = _als_parts(spark, sf_dir)
    metrics = collaborative.fold_metrics(train, blocks=2)
    fitted = F.col("train_rmse") < F.col("mean_rmse")
    return metrics.select("fold", "n_train", "n_test", "n_scored", fitted.alias("fits_better_than_mean"))


@query
def cf_list_facts(spark, sf_dir):
    train, _, user_ids, product_ids = _als_parts(spark, sf_dir)
    model = collaborative.fit_als(train, blocks=2)
    lists = materialise(collaborative.recommend_from_model(model, user_ids, product_ids))
    return collaborative.list_report(model, lists, train, user_ids, product_ids)


@query
def train_recommendations(spark, sf_dir):
    return training.train(shop_events(spark, sf_dir), blocks=2).recommendations


# Serving


@query
def user_history(spark, sf_dir):
    request = views.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    wanted = request.select(F.col("c_custkey").alias("user_id"))
    return readable_time(history.user_history(shop_events(spark, sf_dir), wanted))


@query
def user_tiers(spark, sf_dir):
    return history.user_tiers(interactions(spark, sf_dir), views.users(spark, sf_dir))


@query
def user_tiers_orders(spark, sf_dir):
    return history.user_tiers(views.fulfilled_orders(spark, sf_dir), views.users(spark, sf_dir))


@query
def product_metadata(spark, sf_dir):
    return metadata.metadata_variants(shop_events(spark, sf_dir))


@query
def product_metadata_latest(spark, sf_dir):
    return metadata.latest_metadata(shop_events(spark, sf_dir))


@query
def enrich_metadata(spark, sf_dir):
    events = shop_events(spark, sf_dir)
    return metadata.add_metadata(popularity.popular_items(events), metadata.metadata_variants(events))


def _all_users(spark, sf_dir, of_metadata=metadata.latest_metadata, folded: bool = False) -> DataFrame:
    events, actions = shop_events(spark, sf_dir), interactions(spark, sf_dir)
    documents = tfidf.product_documents(events)
    content = similarity.content_scores(similarity.nest_neighbours(similarity.later_similar_items(documents)))
    return serving.recommend_all_users(
        users=views.users(spark, sf_dir),
        history=actions,
        scored=hybrid.best_hybrid(views.cf_standin(actions), content),
        trending=popularity.trending_items(actions, 10, as_of=AS_OF),
        popular=popularity.popular_items(actions),
        metadata=of_metadata(events),
        folded=folded,
    )


@query
def recommend_all_users(spark, sf_dir):
    return _rounded(_all_users(spark, sf_dir), "final_score", "price")


@query
def recommend_all_users_variants(spark, sf_dir):
    lists = _all_users(spark, sf_dir, metadata.metadata_variants, folded=True)
    return _rounded(
        lists.groupBy("user_id", "tier", "product_id").agg(
            F.sum("n_variants").alias("n_variants"),
            F.max("n_brands").alias("n_brands"),
            F.max("max_price").alias("max_price"),
            F.max("final_score").alias("final_score"),
        ),
        "max_price",
        "final_score",
    )


def _order_lists(spark, sf_dir) -> DataFrame:
    """Lists by what customers have ordered: all three tiers have users."""
    actions, log = interactions(spark, sf_dir), purchase_log(spark, sf_dir)
    products = catalog(spark, sf_dir)
    content = similarity.content_scores(similarity.nest_neighbours(similarity.later_similar_items(products)))
    return serving.recommend_all_users(
        users=views.users(spark, sf_dir),
        history=views.fulfilled_orders(spark, sf_dir),
        scored=hybrid.best_hybrid(views.cf_standin(log), content),
        trending=popularity.trending_items(actions, 10, as_of=AS_OF),
        popular=popularity.popular_items(actions),
        metadata=products,
    )


@query
def recommend_all_users_orders(spark, sf_dir):
    return _rounded(_order_lists(spark, sf_dir), "final_score", "price")


@query
def recs_as_json(spark, sf_dir):
    return serving.as_json(_rounded(_order_lists(spark, sf_dir), "final_score"))


@query
def saved_lists_of_users(spark, sf_dir):
    path = scratch_path(spark, "saved")
    tables.write_recommendations(hybrid.recommendations_for(scored_log(spark, sf_dir)), path, buckets=16, files_per_bucket=2)
    request = views.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return _rounded(tables.read_recommendations_of(spark, path, request.select(F.col("c_custkey").alias("user_id"))), "final_score")


@query
def trained_lists_of_users(spark, sf_dir):
    path = scratch_path(spark, "trained")
    training.run_training_job(shop_events(spark, sf_dir), path, blocks=2)
    lists = tables.read_recommendations_of(spark, path, views.users(spark, sf_dir))
    return lists.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_products"), F.count_distinct("product_id").alias("n_distinct"))


@query
def optional_table(spark, sf_dir):
    path = tables.write_parquet(catalog(spark, sf_dir), scratch_path(spark, "optional"))
    found = [tables.read_if_present(spark, at, "parquet") for at in (path, scratch_path(spark, "never-written"))]
    listed = [part.withColumn("present", F.lit(at)) for at, part in enumerate(found) if part is not None]
    return _rounded(popularity.union_lists(*listed).drop("present"), "price")


@query
def recommend_anonymous(spark, sf_dir):
    events = shop_events(spark, sf_dir)
    return serving.recommend_anonymous(events, metadata.metadata_variants(events), seed=7, as_of=AS_OF)


# Streaming: each runs to the end of its input, then reads what it wrote


def _send(spark, rows: DataFrame, path: str) -> None:
    rows.write.mode("append").text(path)


def _finish(*streams) -> None:
    for stream in streams:
        stream.awaitTermination()


def _ingested(spark, sf_dir) -> tuple[str, str]:
    base = scratch_path(spark, "ingest")
    _send(spark, views.raw_messages(shop_events(spark, sf_dir)), f"{base}/in")
    stream = messages.read_message_files(spark, f"{base}/in")
    _finish(
        *ingest.ingest(
            stream, f"{base}/events", f"{base}/dead", f"{base}/state", KEYED_EVENTS, available_now=True
        )
    )
    return f"{base}/events", f"{base}/dead"


@query
def stream_ingest(spark, sf_dir):
    return readable_time(spark.read.schema(KEYED_EVENTS).parquet(_ingested(spark, sf_dir)[0]))


@query
def stream_dead_letters(spark, sf_dir):
    dead = spark.read.schema("value string, reason string").parquet(_ingested(spark, sf_dir)[1])
    return dead.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("n_chars"))


@query
def stream_append(spark, sf_dir):
    base = scratch_path(spark, "append")
    events = _text_times(shop_events(spark, sf_dir))
    bought = F.col("event_type") == "purchase"
    for arriving in (events.where(bought), events.where(~bought)):
        _send(spark, messages.to_messages(arriving), f"{base}/in")
        decoded = ingest.decode(messages.read_message_files(spark, f"{base}/in"), KEYED_EVENTS)
        good = ingest.good_events(decoded, KEYED_EVENTS)
        _finish(ingest.append_stream(good, f"{base}/events", f"{base}/state", available_now=True))
    return readable_time(spark.read.schema(KEYED_EVENTS).parquet(f"{base}/events"))


def _event_stream(spark, sf_dir, base: str, copies: int = 1) -> DataFrame:
    sent = messages.to_messages(_text_times(shop_events(spark, sf_dir)))
    for _ in range(copies):
        _send(spark, sent, f"{base}/in")
    decoded = ingest.decode(messages.read_message_files(spark, f"{base}/in"), KEYED_EVENTS)
    return ingest.good_events(decoded, KEYED_EVENTS)


@query
def stream_dedupe(spark, sf_dir):
    base = scratch_path(spark, "dedupe")
    unique = ingest.drop_repeats(_event_stream(spark, sf_dir, base, copies=2), "1 day")
    _finish(ingest.append_stream(unique, f"{base}/events", f"{base}/state", available_now=True))
    return readable_time(spark.read.schema(KEYED_EVENTS).parquet(f"{base}/events")).select("event_id", *EVENT_COLUMNS)


@query
def stream_late(spark, sf_dir):
    """Three triggers: the events of the first half without every 97th; the second half, those left
    out and some of the first half again; the last days again."""
    base = scratch_path(spark, "late")
    events = shop_events(spark, sf_dir)
    early = F.col("event_time") < F.lit(views.HALF).cast("timestamp_ntz")
    held, again = F.col("event_id") % 97 == 0, F.col("event_id") % 50 == 0
    for arriving in (early & ~held, ~early | held | again, F.col("event_time") >= F.lit(views.LAST_DAYS).cast("timestamp_ntz")):
        _send(spark, messages.to_messages(_text_times(events.where(arriving))), f"{base}/in")
        decoded = ingest.decode(messages.read_message_files(spark, f"{base}/in"), KEYED_EVENTS)
        good = ingest.good_events(decoded, KEYED_EVENTS)
        _finish(dedupe.dedupe_stream(good, f"{base}/out", f"{base}/state", "1 day", available_now=True))
    unique = dedupe.read_deduped(spark, f"{base}/out", KEYED_EVENTS).withColumn("reason", F.lit("kept"))
    return unique.unionByName(dedupe.read_late(spark, f"{base}/out", KEYED_EVENTS)).select("event_id", "user_id", "reason")


def _snapshot(spark, sf_dir, label: str, table, keys: list[str], part) -> DataFrame:
    """Two triggers, so that the second merges into what the first wrote."""
    base = scratch_path(spark, label)
    events = _text_times(shop_events(spark, sf_dir))
    early = F.col("event_time") < F.lit(views.HALF)
    for arriving in (events.where(early), events.where(~early)):
        _send(spark, messages.to_messages(arriving), f"{base}/in")
        decoded = ingest.decode(messages.read_message_files(spark, f"{base}/in"), KEYED_EVENTS)
        scores = table(ingest.good_events(decoded, KEYED_EVENTS))
        _finish(streaming_popularity.snapshot_stream(scores, f"{base}/scores", f"{base}/state", keys, part, available_now=True))
    return streaming_popularity.read_snapshot(spark, f"{base}/scores")


@query
def stream_popularity(spark, sf_dir):
    return _snapshot(
        spark, sf_dir, "popularity", streaming_popularity.running_scores, ["product_id"], streaming_popularity.product_bucket()
    )


@query
def stream_trending(spark, sf_dir):
    daily = _snapshot(
        spark, sf_dir, "trending", streaming_popularity.daily_scores, ["day_start", "product_id"], streaming_popularity.day_folder()
    )
    return readable_time(daily, "day_start")
