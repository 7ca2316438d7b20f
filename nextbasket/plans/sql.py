"""The queries as SQL over the star schema, for comparison."""

from __future__ import annotations

from ..operators.analytics import STOP_WORDS

TRAIN_START, CUTOFF = "1999-01-01", "2000-10-01"
AGE = "CASE WHEN age > 15 AND age <= 25 THEN '16-24' WHEN age > 25 AND age <= 35 THEN '25-34' WHEN age > 35 AND age <= 45 THEN '35-44' WHEN age > 45 AND age <= 55 THEN '45-54' WHEN age > 55 AND age <= 65 THEN '55-64' WHEN age > 65 AND age <= 100 THEN '65+' END"
CTES = f"""WITH tx AS (
  SELECT CAST(o_orderdate AS DATE) AS t_dat, o_custkey AS customer_id, l_partkey AS article_id, l_extendedprice / l_quantity AS price,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 2 END AS sales_channel_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cust AS (
  SELECT *, {AGE} AS age_group FROM (SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 20 <> 0 THEN CAST(14 + c_custkey % 70 AS DOUBLE) END AS age,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'PRE-CREATE' ELSE 'ACTIVE' END AS club_member_status, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS fashion_news_frequency FROM customer)),
art AS (
  SELECT p_partkey AS article_id, p_name AS prod_name, p_name AS detail_desc, p_brand || ' ' || p_name AS product_code, p_type AS product_group_name, p_brand AS index_group_name, p_brand AS index_name,
         split_part(p_name, ' ', 1) AS colour_group_name, split_part(p_name, ' ', 2) AS product_type_name, p_size AS section_no, p_type || ' ' || CAST(p_size % 5 AS VARCHAR) AS garment_group_name FROM part),
b AS (SELECT max(t_dat) AS mx, max(t_dat) - 6 AS test_start, max(t_dat) - 13 AS val_start FROM tx),
train AS (SELECT tx.* FROM tx, b WHERE t_dat >= DATE '{TRAIN_START}' AND t_dat < test_start),
test AS (SELECT tx.* FROM tx, b WHERE t_dat >= test_start),
truth AS (SELECT DISTINCT customer_id, article_id FROM test),
users AS (SELECT DISTINCT customer_id FROM truth),
tb AS (SELECT max(t_dat) AS mx FROM train),
w7 AS (SELECT tx.* FROM tx, b WHERE t_dat < test_start AND t_dat >= test_start - 7),
w14 AS (SELECT tx.* FROM tx, b WHERE t_dat < test_start AND t_dat >= test_start - 14),
w60 AS (SELECT tx.* FROM tx, b WHERE t_dat < test_start AND t_dat >= test_start - 60)"""


def ranked(select: str, by: str, order: str, source: str, k: int | str = "NULL", rank: str = "rank") -> str:
    """Rows of source with a rank, cut at k."""
    part = f"PARTITION BY {by} " if by else ""
    inner = f"SELECT {select}, CAST(row_number() OVER ({part}ORDER BY {order}) AS INTEGER) AS {rank} FROM {source}"
    return f"SELECT * FROM ({inner}) WHERE {rank} <= {k}" if k != "NULL" else inner


def top(source: str, n: int) -> str:
    return ranked("article_id, n", "", "n DESC, article_id", f"(SELECT article_id, count(*) AS n FROM {source} GROUP BY 1)", n)


def filled(own: str, fallback: str, k: int = 12, seen: str = "SELECT NULL AS customer_id, NULL AS article_id WHERE false") -> str:
    """own: customer_id, rank, article_id within k."""
    both = f"""(SELECT customer_id, 0 AS late, rank AS place, article_id FROM ({own}) UNION ALL
      SELECT u.customer_id, 1, f.rank, f.article_id FROM users u, ({fallback}) f WHERE NOT EXISTS (SELECT 1 FROM ({own}) o WHERE o.customer_id = u.customer_id AND o.article_id = f.article_id)
      AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.customer_id = u.customer_id AND s.article_id = f.article_id))"""
    return f"SELECT customer_id, rank, article_id FROM ({ranked('customer_id, article_id', 'customer_id', 'late, place', both, k)})"


def history(k: int, restrict: bool = True) -> str:
    source = "train" + (" WHERE customer_id IN (SELECT customer_id FROM users)" if restrict else "")
    return ranked("customer_id, article_id, last", "customer_id", "last DESC, article_id", f"(SELECT customer_id, article_id, max(t_dat) AS last FROM {source} GROUP BY 1, 2)", k)


RECENT = "(SELECT train.* FROM train, tb WHERE t_dat >= mx - 14)"
REPURCHASE = filled(history(12), top(RECENT, 24))
GLOBAL = f"SELECT customer_id, rank, article_id FROM users, ({top('train', 12)})"
RECENT_POP = f"SELECT customer_id, rank, article_id FROM users, ({top(RECENT, 12)})"


def segment(source: str, n: int | str) -> str:
    return ranked("age_group, article_id, n", "age_group", "n DESC, article_id", f"(SELECT age_group, article_id, count(*) AS n FROM {source} s JOIN cust USING (customer_id) WHERE age_group IS NOT NULL GROUP BY 1, 2)", n)


SEGMENTED = f"""SELECT u.customer_id, l.rank, l.article_id FROM users u LEFT JOIN cust c USING (customer_id) JOIN (
  SELECT age_group, rank, article_id FROM ({segment('train', 12)}) UNION ALL SELECT '', rank, article_id FROM ({top('train', 12)})) l
  ON l.age_group = CASE WHEN c.age_group IN (SELECT age_group FROM ({segment('train', 1)})) THEN c.age_group ELSE '' END"""


def ap(predictions: str, model: str = "") -> str:
    """customer_id, ap over truth users."""
    return f"""SELECT customer_id, coalesce(p, 0) / least(size, 12) AS ap FROM (SELECT customer_id, count(*) AS size FROM truth GROUP BY 1) LEFT JOIN (
      SELECT customer_id, sum(hits / rank) AS p FROM (SELECT customer_id, rank, CAST(count(*) OVER (PARTITION BY customer_id ORDER BY rank) AS DOUBLE) AS hits FROM ({predictions}) JOIN truth USING (customer_id, article_id)) GROUP BY 1) USING (customer_id)"""


MODELS = {"age_segmented": SEGMENTED, "global": GLOBAL, "recent": RECENT_POP, "repurchase": REPURCHASE}
SCORES = " UNION ALL ".join(f"SELECT '{m}' AS model, avg(ap) AS map, count(*) AS users FROM ({ap(p)})" for m, p in MODELS.items())
# item CF
CF = """, cf_rows AS (SELECT train.* FROM train, tb WHERE t_dat >= mx - 728 AND article_id IN (SELECT article_id FROM train, tb WHERE t_dat >= mx - 728 GROUP BY 1 HAVING count(*) >= 5)),
cf_pairs AS (SELECT DISTINCT customer_id, article_id FROM cf_rows),
cf_n AS (SELECT article_id, count(*) AS n FROM cf_pairs GROUP BY 1),
cf_half AS (SELECT a.article_id AS item_i, c.article_id AS item_j, count(*) AS co FROM cf_pairs a JOIN cf_pairs c USING (customer_id) WHERE a.article_id < c.article_id GROUP BY 1, 2),
cf_one AS (SELECT item_i, item_j, co, round(co / sqrt(x.n * y.n), 9) AS sim FROM cf_half JOIN cf_n x ON x.article_id = item_i JOIN cf_n y ON y.article_id = item_j),
cf_sim AS (SELECT * FROM cf_one UNION ALL SELECT item_j, item_i, co, sim FROM cf_one),
cf_near AS (""" + ranked("item_i, item_j, co, sim", "item_i", "sim DESC, item_j", "cf_sim", 100) + """),
cf_score AS (SELECT customer_id, item_j AS article_id, round(sum(sim), 6) AS score FROM cf_pairs JOIN cf_near ON item_i = article_id JOIN users USING (customer_id) GROUP BY 1, 2),
cf_kept AS (SELECT * FROM cf_score s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM cf_pairs p WHERE p.customer_id = s.customer_id AND p.article_id = s.article_id)),
cf_best AS (""" + ranked("customer_id, article_id, score", "customer_id", "score DESC, article_id", "cf_kept", 12) + ")"
ITEM_CF = filled("SELECT customer_id, rank, article_id FROM cf_best", top("cf_rows", 100), 12, "SELECT customer_id, article_id FROM cf_pairs WHERE customer_id IN (SELECT customer_id FROM cf_best)")
# candidates
POP = {s: f"SELECT customer_id, article_id, '{s}' AS source, rank AS cand_rank FROM users, ({top(w, 100)})" for s, w in (("pop_7d", "w7"), ("pop_14d", "w14"), ("popular_global", "w14"))}
LAST5 = ranked("customer_id, article_id", "customer_id", "t_dat DESC, article_id", "(SELECT tx.* FROM tx, b WHERE t_dat < test_start AND customer_id IN (SELECT customer_id FROM users))", 5)
RECENT_USER = f"SELECT customer_id, article_id, 'recent_user' AS source, min(rank) AS cand_rank FROM ({LAST5}) GROUP BY 1, 2"
_ORDER = "CASE source WHEN 'pop_7d' THEN 0 WHEN 'pop_14d' THEN 1 ELSE 2 END"
COMPACT = f"SELECT customer_id, article_id, source, cand_rank FROM ({ranked('*', 'customer_id, article_id', _ORDER, f'({POP["pop_7d"]} UNION ALL {POP["pop_14d"]} UNION ALL {RECENT_USER})', 1, 'pick')})"


def bought(window: str) -> str:
    return f"(SELECT customer_id, article_id, max(t_dat) AS last, count(*) AS n FROM {window} WHERE customer_id IN (SELECT customer_id FROM users) GROUP BY 1, 2)"


def named(rows: str, source: str) -> str:
    return f"SELECT customer_id, article_id, '{source}' AS source, rank AS cand_rank FROM ({rows})"


SHORT = named(ranked("customer_id, article_id", "customer_id", "last DESC, article_id", bought("w14")), "repurchase_short")
LONG = named(ranked("customer_id, article_id", "customer_id", "last DESC, article_id", bought("w60"), 50), "repurchase_long")
_OTHERS = f"""(SELECT DISTINCT o.customer_id, y.article_id, coalesce(s.sold, 0) AS sold FROM {bought('w60')} o JOIN art x USING (article_id) JOIN art y ON y.product_code = x.product_code LEFT JOIN (SELECT article_id, count(*) AS sold FROM w60 GROUP BY 1) s ON s.article_id = y.article_id
  WHERE NOT EXISTS (SELECT 1 FROM {bought('w60')} z WHERE z.customer_id = o.customer_id AND z.article_id = y.article_id))"""
CODE = named(ranked("customer_id, article_id", "customer_id", "sold DESC, article_id", _OTHERS, 30), "product_code_repurchase")
SEGMENT = f"SELECT customer_id, article_id, 'popular_segment' AS source, rank AS cand_rank FROM users JOIN cust USING (customer_id) JOIN ({segment('w14', 30)}) USING (age_group)"
_LIKED = ranked("customer_id, product_group_name", "customer_id", "n DESC, product_group_name", "(SELECT customer_id, product_group_name, count(*) AS n FROM (SELECT tx.* FROM tx, b WHERE t_dat < test_start AND customer_id IN (SELECT customer_id FROM users)) JOIN art USING (article_id) GROUP BY 1, 2)", 3, "liked")
_SOLD = ranked("product_group_name, article_id, sold", "product_group_name", "sold DESC, article_id", "(SELECT product_group_name, article_id, count(*) AS sold FROM w14 JOIN art USING (article_id) GROUP BY 1, 2)", 20, "place")
CATEGORY = named(ranked("customer_id, article_id", "customer_id", "sold DESC, article_id", f"(SELECT * FROM ({_LIKED}) JOIN ({_SOLD}) USING (product_group_name))", 20), "category_popular")
OBSOLETE = f"SELECT article_id FROM tx GROUP BY 1 HAVING avg(CASE WHEN t_dat < DATE '{CUTOFF}' THEN 1.0 ELSE 0.0 END) >= 0.95"
PRIORITY = "CASE source WHEN 'repurchase_short' THEN 6 WHEN 'repurchase_long' THEN 5 WHEN 'product_code_repurchase' THEN 4 WHEN 'category_popular' THEN 3 WHEN 'popular_segment' THEN 2 WHEN 'popular_global' THEN 1 ELSE 0 END"
_ALL = " UNION ALL ".join((SHORT, LONG, CODE, POP["popular_global"], SEGMENT, CATEGORY))
FULL = f"SELECT customer_id, article_id, source, cand_rank FROM ({ranked('*', 'customer_id, article_id', f'{PRIORITY} DESC', f'(SELECT * FROM ({_ALL}) WHERE article_id NOT IN ({OBSOLETE}))', 1, 'pick')})"
QUOTA = "CASE source WHEN 'repurchase_short' THEN 10 WHEN 'repurchase_long' THEN 6 WHEN 'product_code_repurchase' THEN 5 WHEN 'popular_global' THEN 10 WHEN 'popular_segment' THEN 5 WHEN 'category_popular' THEN 5 ELSE 0 END"
_TURN = "CASE source WHEN 'repurchase_short' THEN 0 WHEN 'repurchase_long' THEN 1 WHEN 'product_code_repurchase' THEN 2 WHEN 'popular_global' THEN 3 WHEN 'popular_segment' THEN 4 WHEN 'category_popular' THEN 5 ELSE 6 END"
_PLACED = f"(SELECT *, {PRIORITY} AS pri, {_TURN} AS turn, place <= {QUOTA} AS first FROM ({ranked('*', 'customer_id, source', 'cand_rank, article_id', 'g', rank='place')}))"
STRATIFIED = f"SELECT customer_id, rank, article_id, source FROM ({ranked('customer_id, article_id, source', 'customer_id', 'first DESC, CASE WHEN first THEN turn ELSE -pri END, cand_rank, source, article_id', _PLACED, 40)})"
LABELS = "SELECT g.*, CASE WHEN t.customer_id IS NULL THEN 0 ELSE 1 END AS label FROM g LEFT JOIN truth t ON t.customer_id = g.customer_id AND t.article_id = g.article_id"
HARD = "CASE source WHEN 'repurchase_short' THEN 1.0 WHEN 'repurchase_long' THEN 0.9 WHEN 'product_code_repurchase' THEN 0.75 ELSE 0.1 END"
NEGATIVES = f"SELECT customer_id, article_id, source, cand_rank, label FROM (SELECT *, sum(label) OVER (PARTITION BY customer_id) AS pos, row_number() OVER (PARTITION BY customer_id, label ORDER BY {HARD} DESC, cand_rank, article_id) AS place FROM ({LABELS})) WHERE label = 1 OR place <= greatest(30, pos * 50)"
_TREND = ranked("product_group_name, article_id, n", "product_group_name", "n DESC, article_id", "(SELECT product_group_name, article_id, count(*) AS n FROM r2 JOIN art USING (article_id) GROUP BY 1, 2)", 5, "place")
TRENDING = ranked("product_group_name, article_id", "", "product_group_name, place", f"({_TREND})", 50)
R2 = f", r2 AS (SELECT * FROM {RECENT})"
COLD = f"""SELECT customer_id, rank, article_id, CASE pos % 3 WHEN 0 THEN 'cold_start_age' WHEN 1 THEN 'cold_start_category' ELSE 'cold_start_global' END AS source FROM (SELECT customer_id, CASE WHEN age_group IN (SELECT age_group FROM names) THEN age_group ELSE '' END AS age_group FROM users LEFT JOIN cust USING (customer_id)) JOIN ({ranked('age_group, article_id, pos', 'age_group', 'pos', '''(SELECT age_group, article_id, min(3 * (rank - 1) + turn) AS pos FROM lists GROUP BY 1, 2)''', 200)}) USING (age_group)"""
COLD_CTES = R2 + f""", seg AS ({segment('r2', 50)}), names AS (SELECT DISTINCT age_group FROM seg UNION ALL SELECT ''), overall AS ({top('r2', 50)}),
lists AS (SELECT age_group, article_id, rank, 0 AS turn FROM seg UNION ALL SELECT '', article_id, rank, 0 FROM overall UNION ALL SELECT age_group, article_id, rank, 1 FROM names, ({TRENDING}) WHERE rank <= 30 UNION ALL SELECT age_group, article_id, rank, 2 FROM names, overall WHERE rank <= 30)"""
RECALL = """SELECT 'all' AS source, count(*) AS users, CAST(sum(coalesce(n, 0)) AS BIGINT) AS candidates, round(avg(coalesce(hits, 0) / size), 6) AS recall, round(median(coalesce(hits, 0) / size), 6) AS median_recall FROM sizes LEFT JOIN (SELECT customer_id, count(DISTINCT hit) AS hits, count(*) AS n FROM h GROUP BY 1) USING (customer_id)
UNION ALL SELECT source, count(*), CAST(sum(n) AS BIGINT), round(sum(hits) / sum(size), 6), NULL FROM (SELECT source, customer_id, count(hit) AS hits, count(*) AS n FROM h GROUP BY 1, 2) JOIN sizes USING (customer_id) GROUP BY 1"""
G = f", g AS ({FULL})"
H = G + ", sizes AS (SELECT customer_id, CAST(count(*) AS DOUBLE) AS size FROM truth GROUP BY 1), h AS (SELECT g.*, t.article_id AS hit FROM g LEFT JOIN truth t ON t.customer_id = g.customer_id AND t.article_id = g.article_id)"
# features before test_start
F0 = ", hist AS (SELECT tx.* FROM tx, b WHERE t_dat < test_start), own AS (SELECT * FROM hist WHERE customer_id IN (SELECT customer_id FROM users))"
USTATS = "SELECT customer_id, count(*) AS u_tx, count(DISTINCT article_id) AS u_unique, round(avg(price), 6) AS u_avg_price, CAST(max(test_start) - max(t_dat) AS INTEGER) AS u_recency FROM own, b GROUP BY 1"
ISTATS = "SELECT article_id, count(*) AS i_tx, round(avg(price), 6) AS i_avg_price, CAST(max(test_start) - max(t_dat) AS INTEGER) AS i_recency FROM hist, b GROUP BY 1"
UI = "SELECT customer_id, article_id, count(*) AS ui_cnt FROM own GROUP BY 1, 2"


def feature_sql(candidates: str, hist: str, t: str) -> str:
    """The 13 compact features; hist and t name a table and a date."""
    return f"""SELECT c.customer_id, c.article_id, c.source, c.cand_rank, CAST(coalesce(u_tx, 0) AS DOUBLE) AS u_tx, CAST(coalesce(u_unique, 0) AS DOUBLE) AS u_unique, round(coalesce(u_avg, 0), 6) AS u_avg_price, CAST(coalesce(u_rec, 0) AS DOUBLE) AS u_recency,
  CAST(coalesce(i_tx, 0) AS DOUBLE) AS i_tx, round(coalesce(i_avg, 0), 6) AS i_avg_price, CAST(coalesce(i_rec, 0) AS DOUBLE) AS i_recency, CAST(coalesce(ui, 0) AS DOUBLE) AS ui_cnt, round(ln(1 + coalesce(i_tx, 0)), 6) AS pop_bias, round(1 / (1 + coalesce(i_rec, 999)), 6) AS recency_bias,
  round(ln(1 + coalesce(u_tx, 0)), 6) AS user_activity, round(coalesce(abs(u_avg - i_avg), 0), 6) AS price_gap, CAST(CASE c.source WHEN 'recent_user' THEN 3 WHEN 'pop_7d' THEN 2 WHEN 'pop_14d' THEN 1 ELSE 0 END AS DOUBLE) AS source_rank
  FROM ({candidates}) c LEFT JOIN (SELECT customer_id, count(*) AS u_tx, count(DISTINCT article_id) AS u_unique, avg(price) AS u_avg, {t} - max(t_dat) AS u_rec FROM {hist} GROUP BY 1) USING (customer_id)
  LEFT JOIN (SELECT article_id, count(*) AS i_tx, avg(price) AS i_avg, {t} - max(t_dat) AS i_rec FROM {hist} GROUP BY 1) USING (article_id) LEFT JOIN (SELECT customer_id, article_id, count(*) AS ui FROM {hist} GROUP BY 1, 2) USING (customer_id, article_id)"""


T0 = "(SELECT test_start FROM b)"
USER_FULL = f"""SELECT customer_id, n_tx, days_since_last, avg_price, price_std, n_unique_articles, n_unique_categories, tx_14d, tx_30d, online_ratio, avg_tx_per_week, repurchase_rate, age, CASE WHEN club_member_status = 'ACTIVE' THEN 1 ELSE 0 END AS is_member FROM (
  SELECT customer_id, count(*) AS n_tx, CAST({T0} - max(t_dat) AS INTEGER) AS days_since_last, round(avg(price), 6) AS avg_price, round(stddev_samp(price), 6) AS price_std, count(DISTINCT article_id) AS n_unique_articles, count(DISTINCT product_group_name) AS n_unique_categories,
  count(*) FILTER (t_dat >= {T0} - 14) AS tx_14d, count(*) FILTER (t_dat >= {T0} - 30) AS tx_30d, round(avg(CASE WHEN sales_channel_id = 2 THEN 1.0 ELSE 0.0 END), 6) AS online_ratio, round(count(*) / greatest(1.0, ({T0} - min(t_dat)) / 7.0::DOUBLE), 6) AS avg_tx_per_week FROM own LEFT JOIN art USING (article_id) GROUP BY 1)
  JOIN (SELECT customer_id, round(avg(CASE WHEN ui_cnt > 1 THEN 1.0 ELSE 0.0 END), 6) AS repurchase_rate FROM ({UI}) GROUP BY 1) USING (customer_id) LEFT JOIN cust USING (customer_id)"""


def code_sql(column: str) -> str:
    return f"SELECT {column}, CAST(dense_rank() OVER (ORDER BY {column}) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {column} FROM art WHERE {column} IS NOT NULL)"


ARTICLE_FULL = f"""SELECT article_id, CAST(pop_1w AS BIGINT) AS pop_1w, CAST(pop_2w AS BIGINT) AS pop_2w, CAST(pop_4w AS BIGINT) AS pop_4w, CAST(pop_all AS BIGINT) AS pop_all, avg_price, round(pop_1w / (pop_4w / 4 + 1), 6) AS trend, CAST(sum(pop_2w) OVER (PARTITION BY product_group_name) AS BIGINT) AS category_pop_2w, x.code AS colour_code, y.code AS product_type_code, z.code AS section_code FROM (
  SELECT art.*, coalesce(p1, 0) AS pop_1w, coalesce(p2, 0) AS pop_2w, coalesce(p4, 0) AS pop_4w, coalesce(pa, 0) AS pop_all, avg_price FROM art LEFT JOIN (SELECT article_id, count(*) FILTER (t_dat >= {T0} - 7) AS p1, count(*) FILTER (t_dat >= {T0} - 14) AS p2, count(*) FILTER (t_dat >= {T0} - 28) AS p4, count(*) AS pa, round(avg(price), 6) AS avg_price FROM hist GROUP BY 1) USING (article_id))
  JOIN ({code_sql('colour_group_name')}) x USING (colour_group_name) JOIN ({code_sql('product_type_name')}) y USING (product_type_name) JOIN ({code_sql('section_no')}) z USING (section_no)"""
INTERACTION = f"""SELECT g.customer_id, g.article_id, CASE WHEN n > 0 THEN 1 ELSE 0 END AS has_purchased, coalesce(n, 0) AS purchase_count, CAST(coalesce({T0} - last, 9999) AS INTEGER) AS days_since, round(coalesce(exp(-({T0} - last) / 30.0::DOUBLE), 0), 6) AS recency_score,
  CASE WHEN coalesce(codes, 0) > CASE WHEN n > 0 THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS same_product_code, coalesce(cats, 0) AS category_purchases, round(abs(own_price - item_price), 6) AS price_affinity, {PRIORITY} AS candidate_source
  FROM g LEFT JOIN art USING (article_id) LEFT JOIN (SELECT customer_id, article_id, count(*) AS n, max(t_dat) AS last FROM o GROUP BY 1, 2) USING (customer_id, article_id) LEFT JOIN (SELECT customer_id, product_code, count(DISTINCT article_id) AS codes FROM o GROUP BY 1, 2) USING (customer_id, product_code)
  LEFT JOIN (SELECT customer_id, product_group_name, count(*) AS cats FROM o GROUP BY 1, 2) USING (customer_id, product_group_name) LEFT JOIN (SELECT customer_id, avg(price) AS own_price FROM o GROUP BY 1) USING (customer_id) LEFT JOIN (SELECT article_id, avg(price) AS item_price FROM hist GROUP BY 1) USING (article_id)"""
PLACES = f"{ranked('age_group, article_id, n', 'age_group', 'n DESC, article_id', '''(SELECT 'all' AS age_group, article_id, count(*) AS n FROM w14 GROUP BY 2 UNION ALL SELECT age_group, article_id, count(*) FROM w14 JOIN cust USING (customer_id) WHERE age_group IS NOT NULL GROUP BY 1, 2)''', rank='place')}"
WEEKLY = "SELECT CAST(date_trunc('week', t_dat) AS DATE) AS week, count(*) AS tx, count(DISTINCT customer_id) AS customers, count(DISTINCT article_id) AS articles, round(sum(price), 4) AS revenue FROM tx GROUP BY 1 HAVING CAST(date_trunc('week', t_dat) AS DATE) < (SELECT CAST(date_trunc('week', max(t_dat)) AS DATE) FROM tx)"
PROFILED = {
    "articles": ("art", ("article_id", "prod_name", "detail_desc", "product_code", "product_group_name", "index_group_name", "index_name", "colour_group_name", "product_type_name", "section_no", "garment_group_name")),
    "customers": ("cust", ("customer_id", "age", "club_member_status", "fashion_news_frequency")), "transactions": ("tx", ("t_dat", "customer_id", "article_id", "price", "sales_channel_id")),
}
PROFILE = " UNION ALL ".join(f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, round(100 * (1 - count({c}) / count(*)), 6) AS null_pct FROM {rows}" for name, (rows, columns) in PROFILED.items() for c in columns)
WEEKS = "(SELECT tx.*, CAST(floor((mx - t_dat) / 7.0) AS INTEGER) AS week FROM tx, b)"
APPENDED = """known AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS code FROM (SELECT DISTINCT customer_id FROM tx, b WHERE t_dat < mx - 60)) SELECT customer_id, CAST(code AS INTEGER) AS customer_id_int FROM known
  UNION ALL SELECT customer_id, CAST((SELECT count(*) FROM known) + row_number() OVER (ORDER BY customer_id) - 1 AS INTEGER) FROM (SELECT DISTINCT customer_id FROM tx WHERE customer_id NOT IN (SELECT customer_id FROM known))"""
def histogram(rows: str, value: str, bins: int, more: str = "") -> str:
    """bin and counts of rows by equal bins between the ends of value."""
    at = f"floor(round((v - CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * {bins}, 9))"
    return f"SELECT CAST(least({at}, {bins - 1}) AS INTEGER) AS bin, {more or 'count(*) AS n'} FROM (SELECT CAST({value} AS DOUBLE) AS v, min(CAST({value} AS DOUBLE)) OVER () AS lo, max(CAST({value} AS DOUBLE)) OVER () AS hi FROM {rows} WHERE {value} IS NOT NULL) GROUP BY 1"


def _values(table: str, c: str) -> str:
    return f"SELECT \"column\", value, n FROM ({ranked('*', '', 'n DESC, value', f"""(SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 2)""", 20, 'place')})"


VALUE_COLUMNS = (("art", ("product_group_name", "index_group_name", "colour_group_name", "product_type_name", "garment_group_name")), ("cust", ("club_member_status", "fashion_news_frequency")))
VALUES = " UNION ALL ".join(_values(t, c) for t, cs in VALUE_COLUMNS for c in cs)
PER = "(SELECT customer_id, count(*) AS c FROM tx GROUP BY 1)"
CDF = f"SELECT purchases, customers, sum(customers) OVER (ORDER BY purchases) / sum(customers) OVER () AS cdf FROM (SELECT c AS purchases, count(*) AS customers FROM {PER} GROUP BY 1)"
REPEAT = "SELECT round(avg(r), 6) AS mean, round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_0, round(avg(CASE WHEN r > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_over_half FROM (SELECT customer_id, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT customer_id, article_id, count(*) AS n FROM tx GROUP BY 1, 2) GROUP BY 1)"
GROUPS = ("ECONOMY", "PROMO", "STANDARD")
MONTHLY = f"SELECT product_group_name, month, round(mean, 6) AS mean, n, round(std, 6) AS std, round(std / sqrt(n), 6) AS se, round(mean - 1.96 * std / sqrt(n), 6) AS lo, round(mean + 1.96 * std / sqrt(n), 6) AS hi FROM (SELECT product_group_name, CAST(date_trunc('month', t_dat) AS DATE) AS month, avg(price) AS mean, count(*) AS n, stddev_samp(price) AS std FROM tx JOIN art USING (article_id) WHERE product_group_name IN {GROUPS} GROUP BY 1, 2)"
SHARE = """SELECT e.category, e.month, round(100.0 * coalesce(n, 0) / base, 6) AS pct FROM (SELECT category, month, base FROM (SELECT category, count(*) AS base FROM named GROUP BY 1), (SELECT DISTINCT CAST(date_trunc('month', t_dat) AS DATE) AS month FROM tx)) e
  LEFT JOIN (SELECT category, CAST(date_trunc('month', t_dat) AS DATE) AS month, count(*) AS n FROM named GROUP BY 1, 2) USING (category, month)"""
SHARE_CTE = ", named AS (SELECT t_dat, index_group_name || ' | ' || index_name || ' | ' || product_type_name AS category FROM tx JOIN art USING (article_id) WHERE index_group_name || index_name || product_type_name IS NOT NULL)"
PIVOT = """SELECT age_group, product_group_name, coalesce(n, 0) AS tx, round(100.0 * coalesce(n, 0) / base, 6) AS pct FROM (SELECT * FROM (SELECT age_group, count(*) AS base FROM x GROUP BY 1), (SELECT product_group_name FROM art WHERE product_group_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8))
  LEFT JOIN (SELECT age_group, product_group_name, count(*) AS n FROM x GROUP BY 1, 2) USING (age_group, product_group_name)"""
PIVOT_CTE = ", x AS (SELECT age_group, product_group_name FROM tx JOIN cust USING (customer_id) JOIN art USING (article_id) WHERE age_group IS NOT NULL AND product_group_name IS NOT NULL)"
_CHANNELS = "(SELECT 'all' AS channel, price FROM tx UNION ALL SELECT CAST(sales_channel_id AS VARCHAR), price FROM tx)"
QUANTILES = "SELECT channel, " + ", ".join(f"round(quantile_cont(price, {p / 100}), 6) AS q{p}" for p in (25, 50, 75, 90, 95, 99)) + f" FROM {_CHANNELS} GROUP BY 1"
BOX = """SELECT channel, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(min(price) FILTER (within), 6) AS lo, round(max(price) FILTER (within), 6) AS hi, count(*) FILTER (NOT within) AS outliers FROM (
  SELECT *, price >= q25 - 1.5 * (q75 - q25) AND price <= q75 + 1.5 * (q75 - q25) AS within FROM (SELECT CAST(sales_channel_id AS VARCHAR) AS channel, price FROM tx) JOIN (SELECT CAST(sales_channel_id AS VARCHAR) AS channel, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50, quantile_cont(price, 0.75) AS q75 FROM tx GROUP BY 1) USING (channel)) GROUP BY 1, 2, 3, 4"""
PURCHASES = "UNPIVOT (SELECT " + ", ".join(f'round(CAST({e} AS DOUBLE), 1) AS "{n}"' for n, e in (("count", "count(*)"), ("mean", "avg(c)"), ("std", "stddev_samp(c)"), ("min", "min(c)"), ("25%", "quantile_cont(c, 0.25)"), ("50%", "quantile_cont(c, 0.5)"), ("75%", "quantile_cont(c, 0.75)"), ("max", "max(c)"))) + f" FROM {PER}) ON COLUMNS(*) INTO NAME statistic VALUE value"
OLD_RATIOS = f"(SELECT avg(CASE WHEN t_dat < DATE '{CUTOFF}' THEN 1.0 ELSE 0.0 END) AS old_ratio FROM tx GROUP BY article_id)"


def frame_week(k: int) -> str:
    """The training rows of the k-th label week before the test week; names inside stand for the time before its first day with sales."""
    inner = feature_sql(f"SELECT c.*, CASE WHEN y.customer_id IS NULL THEN 0 ELSE 1 END AS label FROM ({COMPACT}) c LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM lab) y ON y.customer_id = c.customer_id AND y.article_id = c.article_id", "past", "(SELECT test_start FROM b)")
    inner = inner.replace("c.cand_rank,", "c.cand_rank, c.label,", 1)
    return f"""SELECT * FROM (WITH lab AS (SELECT train.*, test_start - {7 * (k + 1)} AS label_week FROM train, b WHERE t_dat >= test_start - {7 * (k + 1)} AND t_dat < test_start - {7 * k}), first_day AS (SELECT min(t_dat) AS day, min(label_week) AS label_week FROM lab), past AS (SELECT train.* FROM train, first_day WHERE t_dat < day)
  SELECT *, (SELECT label_week FROM first_day) AS label_week FROM (WITH b AS (SELECT day AS test_start FROM first_day), tx AS (SELECT * FROM past), users AS (SELECT DISTINCT customer_id FROM lab), w7 AS (SELECT past.* FROM past, first_day WHERE t_dat >= day - 7), w14 AS (SELECT past.* FROM past, first_day WHERE t_dat >= day - 14) {inner}))"""


FRAME = " UNION ALL ".join(frame_week(k) for k in (1, 2))


def sample(rows: str, n: int) -> str:
    return f"(SELECT DISTINCT customer_id, md5(customer_id || ':42') AS h FROM {rows} ORDER BY h, customer_id LIMIT {n})"


AGAIN = " UNION ALL ".join(f"SELECT '{k}' AS key, " + ", ".join(f"round(100.0 * count(*) FILTER (days > 0 AND days <= {7 * w}) / count(*), 6) AS w{w}" for w in (1, 2, 3)) + f" FROM (SELECT lead(t_dat) OVER (PARTITION BY customer_id, {k} ORDER BY t_dat) - t_dat AS days FROM (SELECT tx.*, product_code, product_group_name FROM tx JOIN art USING (article_id)))" for k in ("article_id", "product_code", "product_group_name"))
WORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(regexp_replace(lower(detail_desc), '[^a-z]+', ' ', 'g')), ' +')) AS word FROM art) WHERE word <> '' AND word NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ") GROUP BY 1 ORDER BY n DESC, word LIMIT 200"

