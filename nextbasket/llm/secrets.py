"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are bigram counts with the same small addition to each, over the same alphabet, trained from labelled samples; a token whose
log-likelihood ratio passes a threshold is a secret. The table of ratios is a literal of the plan, so tokens are scored
where they stand. DataFrame expressions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Patterns of the contract with the least length of their match (assign: of group 2), in the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "markov")
#: For access and hex the least length is in the pattern: a shorter run holds no other match, so the result is the same.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "markov": "[A-Za-z0-9+/_-]{16,}"}
LEAST_ASSIGNED = 8
#: Token characters of the models, by their place from 1; 0 is the state before the first, and any other character.
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-=."
STATES = len(SYMBOLS) + 1
#: Added to each count: with 1, some 3,000 pairs of ordinary samples would be too few to tell unseen pairs from seen ones.
ADDED = 0.1
#: Ordinary identifiers and long words, the labelled samples of that class. Those of the other class are random
#: strings, which random_samples makes by a rule.
ORDINARY = """
getUserProfileById setDefaultConnectionTimeout maxRetryAttempts readFileContents parseRequestHeaders createTemporaryDirectory
validateInputParameters updateShoppingCartTotal isAuthenticationRequired handleIncomingMessage calculateMonthlyAverage
findAllByCustomerName AbstractBeanFactory DocumentBuilderFactory IllegalArgumentException ArrayIndexOutOfBounds
ConcurrentModificationError HttpServletRequest StringBufferInputStream DatabaseConnectionPool EventListenerRegistry
max_connection_timeout default_configuration_path number_of_partitions customer_order_history last_modified_timestamp
enable_feature_flags average_response_time total_shipping_cost user_account_settings application_log_level
MAXIMUM_BUFFER_SIZE DEFAULT_PAGE_LENGTH ENVIRONMENT_VARIABLE DATABASE_HOST_NAME SERVER_PORT_NUMBER
main-navigation-menu primary-button-large content-wrapper-inner search-results-page footer-copyright-notice
user-profile-picture left-sidebar-column responsive-image-gallery product-detail-view breadcrumb-list-item
src/main/resources/application usr/local/share/documentation etc/network/interfaces home/projects/analysis/results
assets/images/background/header api/version/customers/orders lib/python/site-packages docs/reference/getting-started
static/javascript/framework blog/2019/12/holiday-recipes-for-beginners news/2021/03/election-results-overview
internationalization characteristically responsibilities misunderstanding telecommunications straightforwardness
environmentally extraordinarily representatives interdisciplinary counterproductive disproportionately institutionalized
electromagnetic neuropsychological industrialization uncharacteristically incomprehensible superconductivity microorganisms
well-established-principle state-of-the-art-technology twenty-first-century long-term-relationship father-in-law-and-mother
responsabilidades internacionalmente desafortunadamente caracteristicas extraordinariamente descubrimientos
independientemente constitucionalidad establecimientos electrodomesticos administraciones representaciones
comunicaciones contemporaneos aproximadamente entretenimiento reconocimiento funcionamiento investigaciones
gouvernementales particulierement developpements renseignements professionnellement constitutionnellement
etablissements extraordinairement environnementale approvisionnement fonctionnement comprehension reconnaissance
independamment accompagnement investissements communications administrations representations
Geschwindigkeitsbegrenzung Wissenschaftlerinnen Versicherungsgesellschaft Krankenversicherung Bundesregierung
Donaudampfschifffahrt Unabhaengigkeitserklaerung Verantwortungsbewusstsein Freundschaftsbeziehungen Arbeitslosigkeit
Rechtsschutzversicherung Sehenswuerdigkeiten Aufmerksamkeit Landwirtschaftsministerium Strassenverkehrsordnung
Betriebswirtschaftslehre Lebensmittelgeschaeft Entwicklungszusammenarbeit Gleichberechtigung Datenschutzerklaerung
chapter-17-section-4 version-2-release-candidate figure_12_supplementary table-2020-population-estimates week_03_report
invoice-2018-000123 IMG_20190714_holiday backup-2022-05-31-full model-T1000-series item_000045_description 2019-11-05-weekly-summary
""".split()


def random_samples(spark: SparkSession, n: int = 400) -> DataFrame:
    """value: 5 * n random strings, digests of the numbers below n in forms that keys have: base64, url-safe, letters and digits, upper and lower case with digits."""
    digest = F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 512))), "\r\n", "")
    short = F.concat(*(F.conv(F.substring(F.sha2(F.concat_ws(":", "id", F.lit(k)).cast("binary"), 256), 1, 12), 16, 36) for k in range(4)))
    forms = F.array(digest, F.translate(F.rtrim(digest, F.lit("=")), "+/", "-_"), F.regexp_replace(digest, "[+/=]", ""), short, F.lower(short))
    return spark.range(n).select(F.explode(forms).alias("value"))


def labelled_samples(spark: SparkSession) -> DataFrame:
    """value, secret: some 2,000 random strings and some 150 ordinary identifiers."""
    ordinary = spark.createDataFrame([(x,) for x in ORDINARY], "value string")
    return random_samples(spark).withColumn("secret", F.lit(True)).unionByName(ordinary.withColumn("secret", F.lit(False)))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, row, found: for each row all matches of all patterns as (kind, i, before, match); before is the text between it and the one before."""

    def of(kind: int, pattern: str):
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.split("text", pattern, -1)
        each = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("before"), x["match"].alias("match")))
        return F.when(F.col("text").rlike(pattern), F.filter(each, lambda x: x["match"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,before:int,match:string>>"))

    found = F.concat(*(of(k, PATTERNS[name]) for k, name in enumerate(KINDS)))
    return saved(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", found.alias("found"), F.monotonically_increasing_id().alias("row")))


def spans(found: DataFrame) -> DataFrame:
    """row, start, kind, end, value of all matches; ends exclusive, in code points. Tokens that overlap a span of the fixed patterns are left out."""
    x = found.where("size(found) > 0").select("row", "found").repartition("row").select("row", F.inline("found"))
    end = F.sum(F.col("before") + F.length("match")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    x = x.select("row", "kind", (end - F.length("match")).alias("start"), end.alias("end"), value.alias("value")).where((F.col("kind") != 0) | (F.length("value") >= LEAST_ASSIGNED))
    w, base = Window.partitionBy("row").orderBy("start"), F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(w.rangeBetween(0, Window.unboundedFollowing))
    x = x.select("*", (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))).alias("covered"))
    return x.where(base | ~F.col("covered")).drop("covered")


def symbol(c):
    """1..STATES - 1 for token characters, the others 0."""
    return F.instr(F.lit(SYMBOLS), c)


def pairs(value):
    """For each character of value that of it and the one before, as one number. The text is taken apart once, whatever its length."""
    here = F.transform(F.split(value, ""), symbol)
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(here, 1, F.greatest(F.size(here) - 1, F.lit(0)))), here, lambda last, x: last * STATES + x)


def ratios(samples: DataFrame) -> list[float]:
    """For all STATES ** 2 pairs of symbols the log of the ratio of their probabilities in secret and in ordinary samples(value, secret)."""
    each = samples.where("value is not null and value != ''").select("secret", F.explode(pairs(F.col("value"))).alias("pair"))
    counts = each.groupBy("pair").agg(*(F.sum(F.when(F.col("secret") == s, 1).otherwise(0)).alias(n) for s, n in ((True, "s"), (False, "o"))))
    every = samples.sparkSession.range(STATES * STATES).select(F.col("id").cast("int").alias("pair"))
    w = Window.partitionBy(F.floor(F.col("pair") / STATES))  # of STATES rows
    p = lambda n: (F.coalesce(n, F.lit(0)) + ADDED) / (F.coalesce(F.sum(n).over(w), F.lit(0)) + ADDED * STATES)
    return [r[1] for r in every.join(counts, "pair", "left").select("pair", F.log(p("s")) - F.log(p("o"))).orderBy("pair").collect()]


def scan(docs: DataFrame, samples: DataFrame | None = None, odds: float = 1000.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for each row of docs(doc_id, text, ...).

    samples(value, secret) trains the models; labelled_samples by default. A token of 16 characters or more is a secret if its
    likelihood ratio exceeds odds. Model spans that overlap a base span are not added. Nulls: a null text is empty, a null
    doc_id stays; samples of a null value are left out. Repeated rows are scanned each. Texts and tokens of any length are whole, in time by their length. An empty table gives no rows; with an
    empty table of samples the ratio is 1, so nothing is added. Other columns are dropped.
    """
    found = matches(docs)
    table_ = F.from_json(F.lit(json.dumps(ratios(labelled_samples(docs.sparkSession) if samples is None else samples))), "array<double>")
    score = F.aggregate(pairs(F.col("value")), F.lit(0.0), lambda total, pair: total + F.get(table_, pair))
    kept = spans(found).where((F.col("kind") < 3) | (score > math.log(odds)))
    item = F.struct("start", "kind", "end")
    rows = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("kind") < 3, item))).alias("base"), F.array_sort(F.collect_list(item)).alias("all"))
    rows = found.select("doc_id", "row").join(rows, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    base, every = F.coalesce("base", none), F.coalesce("all", none)
    names = F.array(*map(F.lit, KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(every, lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of every document."""
    return scan(table(spark, sf_dir, "documents"))
