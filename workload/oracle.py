"""The same results as plain SQL over the test tables, for checking."""

from __future__ import annotations

from cartwise.functions.text import STOP_WORDS
from workload.views import AS_OF, HALF, LAST_DAYS

STOP_LIST = ", ".join("'" + word.replace("'", "''") + "'" for word in STOP_WORDS)


def _time(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name or column}"


# Named sub-queries; each entry lists the ones it reads.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "shop_events": (
        (),
        """
        SELECT e.event_id, e.ts AS event_time,
               CASE WHEN e.event_type = 'click' THEN 'cart' ELSE e.event_type END AS event_type,
               e.product_id, CAST(p.p_size AS BIGINT) AS category_id,
               CASE WHEN e.event_id % 13 = 0 THEN NULL
                    ELSE lower(concat(p.p_type, '.', replace(p.p_name, ' ', '.'))) END AS category_code,
               CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE p.p_brand END AS brand,
               CASE WHEN e.event_id % 19 = 0 THEN NULL ELSE e.value END AS price,
               e.user_id,
               concat('s', CAST(e.user_id AS VARCHAR), '-', CAST(CAST(e.ts AS DATE) AS VARCHAR)) AS user_session
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id FROM events) e
        LEFT JOIN part p ON p.p_partkey = e.product_id""",
    ),
    "catalog": (
        (),
        """
        SELECT p_partkey AS product_id, lower(concat(p_type, '.', p_name)) AS category_code,
               p_brand AS brand, p_retailprice AS price FROM part""",
    ),
    "purchase_log": (
        (),
        """
        SELECT o_custkey AS user_id, l_partkey AS product_id, o_orderdate AS event_time,
               CASE l_returnflag WHEN 'A' THEN 'cart' WHEN 'N' THEN 'view' WHEN 'R' THEN 'purchase' END AS event_type,
               l_extendedprice AS price, l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "scored_log": (
        (),
        """
        SELECT o_custkey AS user_id, l_partkey AS product_id,
               CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE sqrt(l_extendedprice * (1 - l_discount)) END AS final_score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "usable_scores": (
        ("scored_log",),
        "SELECT * FROM scored_log WHERE final_score IS NOT NULL AND NOT isnan(final_score)",
    ),
    "best_scores": (
        ("usable_scores",),
        "SELECT user_id, product_id, max(final_score) AS final_score FROM usable_scores GROUP BY ALL",
    ),
    "top_scores": (
        ("best_scores",),
        """
        SELECT user_id, product_id, final_score FROM best_scores
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, product_id) <= 10""",
    ),
    "log_standin": (
        ("purchase_log",),
        """
        SELECT user_id, product_id, round(avg(CASE event_type WHEN 'purchase' THEN 0.5::DOUBLE
               WHEN 'cart' THEN 0.3::DOUBLE WHEN 'view' THEN 0.1::DOUBLE ELSE 0::DOUBLE END), 6) AS predicted_rating
        FROM purchase_log GROUP BY user_id, product_id""",
    ),
    "rated_events": (
        ("shop_events",),
        """
        SELECT *, CASE event_type WHEN 'purchase' THEN 0.5::DOUBLE WHEN 'cart' THEN 0.3::DOUBLE
               WHEN 'view' THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS rating FROM shop_events""",
    ),
    "event_standin": (
        ("rated_events",),
        """
        SELECT user_id, product_id, round(avg(rating), 6) AS predicted_rating
        FROM rated_events GROUP BY user_id, product_id""",
    ),
    "type_counts": (
        ("shop_events",),
        """
        SELECT product_id, count(*) FILTER (event_type = 'view') AS "view",
               count(*) FILTER (event_type = 'cart') AS cart, count(*) FILTER (event_type = 'purchase') AS purchase,
               count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error
        FROM shop_events WHERE product_id IS NOT NULL AND event_type IS NOT NULL GROUP BY product_id""",
    ),
    "popular": (
        ("shop_events",),
        """
        SELECT product_id, count(*) AS score, 'popular' AS source FROM shop_events
        WHERE event_type = 'purchase' AND product_id IS NOT NULL GROUP BY product_id""",
    ),
    "trending_all": (
        ("shop_events",),
        f"""
        SELECT product_id, CAST(coalesce(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2
               WHEN 'purchase' THEN 3 END), 0) AS BIGINT) AS score, 'trending' AS source
        FROM shop_events WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 3650 DAY AND product_id IS NOT NULL
        GROUP BY product_id""",
    ),
    "trending": (
        ("trending_all",),
        "SELECT * FROM trending_all ORDER BY score DESC, product_id LIMIT 50",
    ),
    "trending_ten": (
        ("trending_all",),
        "SELECT * FROM trending_all ORDER BY score DESC, product_id LIMIT 10",
    ),
    "diversified": (
        ("trending_all", "popular"),
        """
        SELECT product_id, score, source FROM (
            SELECT *, 0 AS priority FROM (SELECT * FROM trending_all ORDER BY score DESC, product_id LIMIT 5)
            UNION ALL
            SELECT *, 1 FROM (SELECT * FROM popular ORDER BY md5('7|' || product_id), product_id LIMIT 5))
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY priority) = 1""",
    ),
    "variants": (("shop_events",), "SELECT DISTINCT product_id, category_code, brand, price FROM shop_events"),
    "latest": (
        ("shop_events",),
        """
        SELECT product_id, category_code, brand, price FROM shop_events
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY event_time DESC, event_id DESC) = 1""",
    ),
    # Text and similarity, for the catalogue and for the products of the events.
    "event_documents": (
        ("shop_events",),
        """
        SELECT product_id, coalesce(max(brand), '') AS brand, coalesce(max(category_code), '') AS category_code
        FROM shop_events WHERE product_id IS NOT NULL GROUP BY product_id""",
    ),
}


def _text_views(prefix: str, documents: str) -> None:
    VIEWS[f"{prefix}_terms"] = (
        (documents,),
        f"""
        SELECT product_id, string_split(concat_ws(' ', lower(brand),
               array_to_string(string_split(lower(category_code), '.'), ' ')), ' ') AS terms FROM {documents}""",
    )
    VIEWS[f"{prefix}_positions"] = (
        (f"{prefix}_terms",),
        f"""
        SELECT product_id, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM {prefix}_terms""",
    )
    # Position counts only what is left after the stop words.
    VIEWS[f"{prefix}_filtered"] = (
        (f"{prefix}_positions",),
        f"""
        SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY pos) - 1 AS pos, term
        FROM {prefix}_positions WHERE term NOT IN ({STOP_LIST})""",
    )
    VIEWS[f"{prefix}_tf"] = (
        (f"{prefix}_filtered",),
        f"SELECT product_id, term, count(*) AS tf FROM {prefix}_filtered GROUP BY product_id, term",
    )
    VIEWS[f"{prefix}_df"] = ((f"{prefix}_tf",), f"SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term")
    VIEWS[f"{prefix}_weights"] = (
        (f"{prefix}_tf", f"{prefix}_df", documents),
        f"""
        SELECT product_id, term, tf * ln(CAST((SELECT count(*) FROM {documents}) + 1 AS DOUBLE) / (df + 1)) AS w
        FROM {prefix}_tf JOIN {prefix}_df USING (term)""",
    )
    VIEWS[f"{prefix}_unit"] = (
        (f"{prefix}_weights",),
        f"""
        SELECT product_id, term, coalesce(w / nullif(norm, 0), 0) AS w FROM {prefix}_weights
        JOIN (SELECT product_id, sqrt(sum(w * w)) AS norm FROM {prefix}_weights GROUP BY product_id)
        USING (product_id)""",
    )
    VIEWS[f"{prefix}_pairs"] = (
        (f"{prefix}_unit",),
        f"""
        SELECT * FROM (
            SELECT a.product_id AS i, b.product_id AS j, round(sum(a.w * b.w), 9) AS cosine_similarity
            FROM {prefix}_unit a JOIN {prefix}_unit b ON a.term = b.term AND a.product_id < b.product_id
            GROUP BY a.product_id, b.product_id)
        WHERE cosine_similarity > 0.1""",
    )
    VIEWS[f"{prefix}_near"] = (
        (f"{prefix}_pairs",),
        f"""
        SELECT * FROM (SELECT i, j, cosine_similarity FROM {prefix}_pairs
                       UNION ALL SELECT j, i, cosine_similarity FROM {prefix}_pairs)
        QUALIFY row_number() OVER (PARTITION BY i ORDER BY cosine_similarity DESC, j) <= 10""",
    )
    VIEWS[f"{prefix}_later"] = (
        (f"{prefix}_pairs",),
        f"""
        SELECT i, j, cosine_similarity FROM {prefix}_pairs
        QUALIFY row_number() OVER (PARTITION BY i ORDER BY cosine_similarity DESC, j) <= 10""",
    )
    VIEWS[f"{prefix}_content"] = (
        (f"{prefix}_later",),
        f"""
        SELECT i AS product_id, j AS recommended_product, cosine_similarity * 0.3::DOUBLE AS cbf_score
        FROM {prefix}_later""",
    )


def _hybrid_view(name: str, standin: str, content: str) -> None:
    VIEWS[name] = (
        (standin, content),
        f"""
        SELECT user_id, product_id, recommended_product,
               predicted_rating * 0.7::DOUBLE + coalesce(cbf_score, 0) AS final_score
        FROM {standin} LEFT JOIN {content} USING (product_id)""",
    )


_text_views("catalog", "catalog")
_text_views("event", "event_documents")
_hybrid_view("log_hybrid", "log_standin", "catalog_content")
_hybrid_view("event_hybrid", "event_standin", "event_content")

# Event-weighted IDF: every distinct event row is a document.
VIEWS["row_terms"] = (
    ("shop_events",),
    f"""
    SELECT product_id, event_id, unnest(string_split(concat_ws(' ', lower(coalesce(brand, '')),
           array_to_string(string_split(lower(coalesce(category_code, '')), '.'), ' ')), ' ')) AS term
    FROM shop_events""",
)
VIEWS["row_weighted_unit"] = (
    ("row_terms", "shop_events", "event_tf"),
    f"""
    SELECT product_id, term, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY product_id)), 0), 0) AS w
    FROM (SELECT product_id, term, tf * ln(CAST((SELECT count(*) FROM shop_events) + 1 AS DOUBLE) / (df + 1)) AS w
          FROM event_tf JOIN (SELECT term, count(DISTINCT event_id) AS df FROM row_terms
                              WHERE term NOT IN ({STOP_LIST}) GROUP BY term) USING (term))""",
)


def _tiers(name: str, view: tuple[str, ...], events: str) -> None:
    VIEWS[name] = (
        view,
        f"""
        SELECT c_custkey AS user_id, coalesce(n, 0) AS n_events,
               CASE WHEN coalesce(n, 0) = 0 THEN 'new' WHEN n < 6 THEN 'cold_start' ELSE 'warm' END AS tier
        FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id)
        ON user_id = c_custkey""",
    )


_tiers("tiers", ("shop_events",), "shop_events")
_tiers("tiers_orders", (), "(SELECT o_custkey AS user_id FROM orders WHERE o_orderstatus = 'F')")


def _lists(name: str, tiers: str, hybrid: str, products: str) -> None:
    sampled = "SELECT *, row_number() OVER (ORDER BY md5('42|' || product_id), product_id) AS place FROM"
    VIEWS[name] = (
        (tiers, "trending_ten", "popular", hybrid, products),
        f"""
        WITH picks AS (
            SELECT user_id, product_id, max(final_score) AS final_score FROM {hybrid} GROUP BY user_id, product_id
        ), own AS (
            SELECT * FROM picks JOIN {tiers} USING (user_id) WHERE tier <> 'new'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, product_id) <= 10
        ), t AS ({sampled} trending_ten), p AS ({sampled} popular), candidates AS (
            SELECT user_id, tier, product_id, final_score, NULL AS score, NULL AS source, 0 AS priority
            FROM own WHERE tier = 'warm'
            UNION ALL
            SELECT user_id, tier, product_id, final_score, NULL, NULL, 0 FROM (
                SELECT * FROM own WHERE tier = 'cold_start' QUALIFY row_number() OVER (
                    PARTITION BY user_id ORDER BY md5('42|' || product_id), product_id) <= 4)
            UNION ALL
            SELECT user_id, tier, product_id, NULL, score, source, 1 FROM {tiers}, t
            WHERE (tier = 'new' AND place <= 5) OR (tier = 'cold_start' AND place <= 3)
            UNION ALL
            SELECT user_id, tier, product_id, NULL, score, source, 2 FROM {tiers}, p
            WHERE (tier = 'new' AND place <= 5) OR (tier = 'cold_start' AND place <= 3)
        ), chosen AS (
            SELECT * FROM candidates
            QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY priority) = 1
        )
        SELECT user_id, tier, product_id, coalesce(brand, 'Unknown') AS brand,
               coalesce(category_code, 'Unknown') AS category_code, round(price, 6) AS price,
               round(final_score, 6) AS final_score, score, source
        FROM chosen LEFT JOIN {products} USING (product_id)""",
    )


_lists("lists", "tiers", "event_hybrid", "latest")
_lists("lists_variants", "tiers", "event_hybrid", "variants")
_lists("lists_orders", "tiers_orders", "log_hybrid", "catalog")


def _with(names: list[str]) -> str:
    """A WITH clause of the named views and those they read, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in VIEWS:
            return
        for other in VIEWS[name][0]:
            visit(other)
        ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered) + "\n" if ordered else ""


EVENT_COLUMNS = "event_type, product_id, category_id, category_code, brand, price, user_id, user_session"
ALL_COLUMNS = f"event_id, {_time('event_time')}, {EVENT_COLUMNS}"
FILLED = (
    f"event_id, {_time('event_time')}, event_type, coalesce(product_id, 0) AS product_id, "
    "coalesce(category_id, 0) AS category_id, coalesce(category_code, '') AS category_code, "
    "coalesce(brand, '') AS brand, coalesce(price, 0) AS price, coalesce(user_id, 0) AS user_id, "
    "coalesce(user_session, '') AS user_session"
)
# What a message without nulls reads back as: missing numbers are 0, missing text stays null.
RECEIVED = (
    f"event_id, {_time('event_time')}, event_type, coalesce(product_id, 0) AS product_id, "
    "coalesce(category_id, 0) AS category_id, category_code, brand, coalesce(price, 0) AS price, "
    "coalesce(user_id, 0) AS user_id, user_session"
)
COMPLETE = "category_code IS NOT NULL AND brand IS NOT NULL AND price IS NOT NULL AND product_id IS NOT NULL"
TRAIN_HASH = "CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) % 100 < 80"


def _index(view: str, key: str, name: str) -> str:
    return (
        f"SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS {name} "
        f"FROM (SELECT DISTINCT {key} FROM {view})"
    )


# What each trigger of the de-duplicated stream gets, and what is behind its watermark.
VIEWS["trigger_one"] = (
    ("shop_events",),
    f"SELECT * FROM shop_events WHERE event_time < TIMESTAMP '{HALF}' AND event_id % 97 <> 0",
)
for _name, _before, _which in (
    ("trigger_two", "trigger_one", f"event_time >= TIMESTAMP '{HALF}' OR event_id % 97 = 0 OR event_id % 50 = 0"),
    ("trigger_three", "trigger_two", f"event_time >= TIMESTAMP '{LAST_DAYS}'"),
):
    VIEWS[_name] = (
        ("shop_events", _before),
        f"""
        SELECT *, event_time < (SELECT max(event_time) FROM {_before}) - INTERVAL 1 DAY AS late
        FROM shop_events WHERE {_which}""",
    )

# Ratings with dense ids as the models see them, each row's part and fold.
VIEWS["als_rows"] = (
    ("rated_events",),
    f"""
    SELECT *, CAST('0x' || substr(md5('42|' || row_key), 1, 8) AS BIGINT) % 100 < 80 AS in_train,
           CAST('0x' || substr(md5('42|' || row_key), 1, 8) AS BIGINT) % 3 AS fold
    FROM (SELECT user_id, product_id, user_index, product_index, rating,
                 user_index || '|' || product_index || '|' || CAST(CAST(rating AS FLOAT) AS VARCHAR) AS row_key
          FROM rated_events JOIN ({_index('rated_events', 'user_id', 'user_index')}) USING (user_id)
          JOIN ({_index('rated_events', 'product_id', 'product_index')}) USING (product_id))""",
)
VIEWS["als_train"] = (("als_rows",), "SELECT * FROM als_rows WHERE in_train")

# query -> (views it reads, final SELECT)
CHECKS: dict[str, tuple[list[str], str]] = {
    "scan_events": (["shop_events"], f"SELECT {ALL_COLUMNS} FROM shop_events"),
    "scan_events_csv_inferred": (["shop_events"], f"SELECT event_id, {EVENT_COLUMNS} FROM shop_events"),
    "scan_events_timestamps": (
        ["shop_events"],
        f"SELECT event_id, {_time('event_time')}, epoch_us(event_time) AS epoch_micros FROM shop_events",
    ),
    "recs_roundtrip": (
        ["top_scores"],
        "SELECT user_id, product_id, round(final_score, 6) AS final_score FROM top_scores",
    ),
    "sink_csv_roundtrip": (
        ["top_scores"],
        "SELECT user_id, product_id, round(final_score, 6) AS final_score FROM top_scores",
    ),
    "sink_parquet_roundtrip": (
        ["catalog"],
        "SELECT product_id, category_code, brand, round(price, 6) AS price FROM catalog",
    ),
    "events_json_roundtrip": (["shop_events"], f"SELECT {RECEIVED} FROM shop_events"),
    "clean_fill": (["shop_events"], f"SELECT {FILLED} FROM shop_events"),
    "clean_dropna_any": (["shop_events"], f"SELECT {ALL_COLUMNS} FROM shop_events WHERE {COMPLETE}"),
    "clean_dropna_subset": (
        ["shop_events"],
        f"SELECT {ALL_COLUMNS} FROM shop_events WHERE category_code IS NOT NULL AND brand IS NOT NULL",
    ),
    "dedupe_rows": (["shop_events"], "SELECT DISTINCT product_id, event_type, brand, user_id FROM shop_events"),
    "cap_rows": (
        ["purchase_log"],
        f"""SELECT user_id, product_id, {_time('event_time')}, event_type, price, order_id, line FROM (
            SELECT * FROM purchase_log
            ORDER BY event_time, order_id, line, user_id, product_id, event_type, price LIMIT 20000)""",
    ),
    "rating_events": (["rated_events"], "SELECT event_id, event_type, rating FROM rated_events"),
    "event_pivot": (["type_counts"], "SELECT * FROM type_counts"),
    "popularity_scores": (
        ["type_counts"],
        'SELECT product_id, 3 * purchase + 2 * cart + "view" AS score FROM type_counts '
        "ORDER BY score DESC, product_id LIMIT 10",
    ),
    "trending_scores": (
        ["shop_events"],
        """SELECT product_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2
               WHEN 'purchase' THEN 3 ELSE 0 END) AS BIGINT) AS trend_score
           FROM shop_events WHERE event_time >= (SELECT max(event_time) FROM shop_events) - INTERVAL 7 DAY
             AND product_id IS NOT NULL AND event_type IS NOT NULL
           GROUP BY product_id ORDER BY trend_score DESC, product_id LIMIT 10""",
    ),
    "popular_purchases": (
        ["purchase_log"],
        """SELECT product_id, count(*) AS score, 'popular' AS source FROM purchase_log
           WHERE event_type = 'purchase' GROUP BY product_id""",
    ),
    "trending_items": (["trending"], "SELECT * FROM trending"),
    "trending_items_fortnight": (
        ["shop_events"],
        f"""SELECT product_id, CAST(coalesce(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2
                WHEN 'purchase' THEN 3 END), 0) AS BIGINT) AS score, 'trending' AS source
            FROM shop_events WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY
            GROUP BY product_id""",
    ),
    "trending_items_untimed": (["trending"], "SELECT * FROM trending"),
    "trending_and_popular": (
        ["trending_all", "popular"],
        """SELECT product_id, CAST(sum(score) AS BIGINT) AS score,
                  CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source
           FROM (SELECT * FROM (SELECT * FROM trending_all ORDER BY score DESC, product_id LIMIT 20)
                 UNION ALL SELECT * FROM popular)
           GROUP BY product_id ORDER BY score DESC, product_id LIMIT 10""",
    ),
    "union_sources": (["trending", "popular"], "SELECT * FROM trending UNION ALL SELECT * FROM popular"),
    "dedupe_by_priority": (
        ["trending", "popular"],
        """SELECT * FROM trending UNION ALL
           SELECT * FROM popular WHERE product_id NOT IN (SELECT product_id FROM trending)""",
    ),
    "seeded_sample": (["popular"], "SELECT * FROM popular ORDER BY md5('42|' || product_id), product_id LIMIT 5"),
    "diversified_items": (["diversified"], "SELECT * FROM diversified"),
    "user_index": (["purchase_log"], _index("purchase_log", "user_id", "user_index")),
    "product_index": (["purchase_log"], _index("purchase_log", "product_id", "product_index")),
    "catalog_counts": (
        ["purchase_log"],
        """SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_products FROM purchase_log""",
    ),
    "ratings_matrix": (
        ["rated_events"],
        f"""SELECT user_index, product_index, round(rating, 6) AS rating
            FROM (SELECT * FROM rated_events WHERE {COMPLETE}) r
            JOIN ({_index(f'(SELECT * FROM rated_events WHERE {COMPLETE})', 'user_id', 'user_index')}) USING (user_id)
            JOIN ({_index(f'(SELECT * FROM rated_events WHERE {COMPLETE})', 'product_id', 'product_index')})
            USING (product_id)""",
    ),
    "ratings_matrix_summed": (
        ["purchase_log"],
        f"""SELECT user_index, product_index, round(rating, 6) AS rating FROM (
                SELECT user_id, product_id, sum(CASE event_type WHEN 'purchase' THEN 0.5::DOUBLE
                    WHEN 'cart' THEN 0.3::DOUBLE WHEN 'view' THEN 0.1::DOUBLE END) AS rating
                FROM (SELECT DISTINCT * FROM purchase_log) GROUP BY user_id, product_id)
            JOIN ({_index('purchase_log', 'user_id', 'user_index')}) USING (user_id)
            JOIN ({_index('purchase_log', 'product_id', 'product_index')}) USING (product_id)""",
    ),
    "train_test_split": (
        ["shop_events"],
        f"SELECT event_id, CASE WHEN {TRAIN_HASH} THEN 'train' ELSE 'test' END AS part FROM shop_events",
    ),
    "rating_rmse": (
        ["rated_events"],
        f"""SELECT round(sqrt(avg((m - rating) * (m - rating))), 6) AS rmse FROM rated_events,
                (SELECT avg(rating) AS m FROM rated_events WHERE {TRAIN_HASH})
            WHERE NOT ({TRAIN_HASH})""",
    ),
    "product_tokens": (["catalog_positions"], "SELECT * FROM catalog_positions"),
    "product_tokens_filtered": (["catalog_filtered"], "SELECT * FROM catalog_filtered"),
    "event_product_tokens": (["event_filtered"], "SELECT * FROM event_filtered"),
    "term_frequency": (["catalog_tf"], "SELECT * FROM catalog_tf"),
    "term_document_frequency": (["catalog_df"], "SELECT * FROM catalog_df"),
    "tfidf_weights": (["catalog_weights"], "SELECT product_id, term, round(w, 6) AS w FROM catalog_weights"),
    "tfidf_normalised": (["catalog_unit"], "SELECT product_id, term, round(w, 6) AS w FROM catalog_unit"),
    "item_similarity": (
        ["catalog_pairs"],
        "SELECT i, j, cosine_similarity FROM catalog_pairs",
    ),
    "item_similarity_event_idf": (
        ["row_weighted_unit"],
        """SELECT i, j, cosine_similarity FROM (
               SELECT a.product_id AS i, b.product_id AS j, round(sum(a.w * b.w), 9) AS cosine_similarity
               FROM row_weighted_unit a JOIN row_weighted_unit b ON a.term = b.term AND a.product_id < b.product_id
               GROUP BY a.product_id, b.product_id)
           WHERE cosine_similarity > 0.1""",
    ),
    "similar_items": (
        ["catalog_near"],
        "SELECT i, j, cosine_similarity FROM catalog_near",
    ),
    "similar_items_later": (
        ["catalog_later"],
        "SELECT i, j, cosine_similarity FROM catalog_later",
    ),
    "similar_items_nested": (
        ["catalog_near"],
        """SELECT i AS product_id, string_agg(j, ',' ORDER BY cosine_similarity DESC, j) AS neighbours
           FROM catalog_near GROUP BY i""",
    ),
    "explode_neighbours": (
        ["catalog_content"],
        "SELECT product_id, recommended_product, cbf_score FROM catalog_content",
    ),
    "hybrid_scores": (
        ["log_hybrid"],
        "SELECT user_id, product_id, recommended_product, final_score FROM log_hybrid",
    ),
    "hybrid_best": (
        ["log_hybrid"],
        """SELECT user_id, product_id, round(max(final_score), 6) AS final_score
           FROM log_hybrid GROUP BY user_id, product_id""",
    ),
    "als_normal_equations": (
        ["als_train"],
        "SELECT user_id, count(*) AS n_ratings, true AS solved FROM als_train GROUP BY user_id",
    ),
    "als_scored_rows": (
        ["als_rows", "als_train"],
        """SELECT user_index, product_index, round(rating, 6) AS rating, true AS agrees FROM als_rows
           WHERE NOT in_train AND user_index IN (SELECT user_index FROM als_train)
             AND product_index IN (SELECT product_index FROM als_train)""",
    ),
    "als_fold_facts": (
        ["als_train"],
        """SELECT f.fold, count(*) FILTER (t.fold <> f.fold) AS n_train, count(*) FILTER (t.fold = f.fold) AS n_test,
                  count(*) FILTER (t.fold = f.fold
                      AND EXISTS (SELECT 1 FROM als_train o WHERE o.fold <> f.fold AND o.user_index = t.user_index)
                      AND EXISTS (SELECT 1 FROM als_train o WHERE o.fold <> f.fold AND o.product_index = t.product_index)
                  ) AS n_scored, true AS fits_better_than_mean
           FROM (SELECT DISTINCT fold FROM als_train) f, als_train t GROUP BY f.fold""",
    ),
    "cf_list_facts": (
        ["als_train"],
        """SELECT user_id, least(10, (SELECT count(DISTINCT product_id) FROM als_train)) AS n_products, true AS consistent
           FROM als_train GROUP BY user_id""",
    ),
    "dedupe_across_users": (
        ["log_standin"],
        """SELECT min(user_id) AS user_id, product_id, predicted_rating AS final_score
           FROM log_standin GROUP BY product_id, predicted_rating""",
    ),
    "rank_per_user": (
        ["log_standin"],
        """SELECT user_id, product_id, predicted_rating AS final_score,
                  row_number() OVER (PARTITION BY user_id ORDER BY predicted_rating DESC, product_id) AS rank
           FROM log_standin""",
    ),
    "best_per_user_product": (
        ["best_scores"],
        "SELECT user_id, product_id, round(final_score, 6) AS final_score FROM best_scores",
    ),
    "topk_per_user": (
        ["log_standin"],
        """SELECT user_id, product_id, round(predicted_rating, 6) AS final_score FROM log_standin
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY predicted_rating DESC, product_id) <= 10""",
    ),
    "recs_for_user": (
        ["top_scores"],
        """SELECT user_id, product_id, round(final_score, 6) AS final_score FROM top_scores
           WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    ),
    "user_history": (
        ["shop_events"],
        f"""SELECT {ALL_COLUMNS} FROM shop_events
            WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    ),
    "user_tiers": (["tiers"], "SELECT * FROM tiers"),
    "user_tiers_orders": (["tiers_orders"], "SELECT * FROM tiers_orders"),
    "product_metadata": (["variants"], "SELECT * FROM variants"),
    "product_metadata_latest": (["latest"], "SELECT * FROM latest"),
    "enrich_metadata": (
        ["popular", "variants"],
        """SELECT product_id, score, source, coalesce(category_code, 'Unknown') AS category_code,
                  coalesce(brand, 'Unknown') AS brand, price
           FROM popular LEFT JOIN variants USING (product_id)""",
    ),
    "recommend_all_users": (["lists"], "SELECT * FROM lists"),
    "recommend_all_users_orders": (["lists_orders"], "SELECT * FROM lists_orders"),
    "recommend_all_users_variants": (
        ["lists_variants"],
        """SELECT user_id, tier, product_id, count(*) AS n_variants, count(DISTINCT brand) AS n_brands,
                  max(price) AS max_price, max(final_score) AS final_score
           FROM lists_variants GROUP BY user_id, tier, product_id""",
    ),
    "saved_lists_of_users": (
        ["top_scores"],
        """SELECT user_id, product_id, round(final_score, 6) AS final_score FROM top_scores
           WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    ),
    "trained_lists_of_users": (
        ["als_train"],
        """SELECT user_id, least(10, (SELECT count(DISTINCT product_id) FROM als_train)) AS n_products,
                  least(10, (SELECT count(DISTINCT product_id) FROM als_train)) AS n_distinct
           FROM als_train WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id""",
    ),
    "optional_table": (
        ["catalog"],
        "SELECT product_id, category_code, brand, round(price, 6) AS price FROM catalog",
    ),
    "recs_as_json": (
        ["lists_orders"],
        """SELECT user_id, '[' || string_agg(
               '{"product_id":' || product_id || ',"brand":"' || brand || '","category_code":"' || category_code
               || '"' || coalesce(',"price":' || price, '') || coalesce(',"final_score":' || final_score, '')
               || coalesce(',"score":' || score || ',"source":"' || source || '"', '') || '}', ','
               ORDER BY final_score DESC NULLS LAST, source DESC, score DESC, product_id) || ']' AS recommendations
           FROM lists_orders GROUP BY user_id""",
    ),
    "recommend_anonymous": (
        ["diversified", "variants"],
        """SELECT product_id, score, source, coalesce(category_code, 'Unknown') AS category_code,
                  coalesce(brand, 'Unknown') AS brand, price
           FROM diversified LEFT JOIN variants USING (product_id)""",
    ),
    "stream_ingest": (
        ["shop_events"],
        f"""SELECT {RECEIVED} FROM shop_events
            WHERE event_type <> 'error' AND NOT (event_type = 'signup' AND price IS NULL)""",
    ),
    "stream_dead_letters": (
        ["shop_events"],
        """SELECT 'not_an_object' AS reason, count(*) AS n, CAST(sum(length('ERR event ' || event_id)) AS BIGINT) AS n_chars
           FROM shop_events WHERE event_type = 'error'
           UNION ALL
           SELECT 'null_price', count(*), CAST(sum(length(
               '{"event_id":' || event_id || ',"event_time":"2024-01-01 00:00:00.000000 UTC","event_type":"signup"'
               || ',"product_id":' || product_id || ',"category_id":' || category_id
               || ',"category_code":' || coalesce('"' || category_code || '"', 'null')
               || ',"brand":' || coalesce('"  ' || brand || ' "', 'null') || ',"price":null,"user_id":' || user_id
               || ',"user_session":"' || user_session || '"}')) AS BIGINT)
           FROM shop_events WHERE event_type = 'signup' AND price IS NULL""",
    ),
    "stream_append": (["shop_events"], f"SELECT {RECEIVED} FROM shop_events"),
    "stream_late": (
        ["trigger_one", "trigger_two", "trigger_three"],
        """SELECT event_id, user_id, 'kept' AS reason FROM (
               SELECT event_id, user_id FROM trigger_one
               UNION SELECT event_id, user_id FROM trigger_two WHERE NOT late
               UNION SELECT event_id, user_id FROM trigger_three WHERE NOT late)
           UNION ALL SELECT event_id, user_id, 'late' FROM trigger_two WHERE late
           UNION ALL SELECT event_id, user_id, 'late' FROM trigger_three WHERE late""",
    ),
    "stream_dedupe": (["shop_events"], f"SELECT {RECEIVED} FROM shop_events"),
    "stream_popularity": (
        ["type_counts"],
        'SELECT product_id, 3 * purchase + 2 * cart + "view" AS score FROM type_counts',
    ),
    "stream_trending": (
        ["shop_events"],
        """SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d %H:%M:%S.%f') AS day_start, product_id,
                  CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'cart' THEN 2
                      WHEN 'purchase' THEN 3 ELSE 0 END) AS BIGINT) AS trend_score
           FROM shop_events WHERE product_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2""",
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(reads) + select for name, (reads, select) in CHECKS.items()}
