"""Queries by name, each with its SQL where one exists: every operator applied to the driver's tables.

Records come from `documents` (see ``records_of_documents``); truth is equal text within a country, and the score
that stands in for a model's is a fixed function of the cosines. Numbers are rounded to six decimals.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import CURRENT, EARLIER, Config
from tessera.functions import normalize as n
from tessera.functions.strsim import similarity
from tessera.operators import blocking, decode, dense, diagnosis, embedding, features, metrics, rarity, sampling, tfidf, validate, windows
from tessera.operators.records import prepare
from tessera.plans import crosspair, sql
from tessera.sources.records import id_lists, records_of_documents, truth_pairs
from tessera.sources.scratch import folder, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLES[f.__name__] = text
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    return records_of_documents(table(spark, d, "documents"))


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return prepare(records(spark, d)).drop("body", "doc_id")


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return written(rarity.add_keys(rarity.add_rarity(written(prepared(spark, d), "prepared"))), "keyed")


def truth(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).select("country", "body", "id", "source")
    s, q = rows.where("source = 'S1'"), rows.where("source <> 'S1'")
    return s.select("country", "body", F.col("id").alias("s1_id")).join(q.select("country", "body", F.col("id").alias("q_id")), ["country", "body"]).select("s1_id", "q_id")


def s1_ids(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("source = 'S1'").select(F.col("id").alias("s1_id"))


def scored(spark: SparkSession, d: str, cfg: Config = CURRENT) -> DataFrame:
    found = blocking.candidates(keyed(spark, d), cfg)
    return written(found.withColumn("logit", F.round(12 * F.col("cos_all") + 3 * F.col("cos_name") - 7, 6)), "scored")


SCORED = "scored AS MATERIALIZED (SELECT *, round(12 * cos_all + 3 * cos_name - 7, 6) AS logit FROM candidates)"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- names, addresses, records


@query(f"WITH {sql.PREP} SELECT id, nname, name_sort, acronym, skel FROM prep")
def norm_names(spark, d):
    """Normalised names with their sorted, acronym and skeleton forms."""
    nname = records(spark, d).select("id", n.norm_name(F.col("name")).alias("nname"))
    return nname.select("id", "nname", n.name_sort(F.col("nname")).alias("name_sort"), n.acronym(F.col("nname")).alias("acronym"), n.name_skeleton(F.col("nname")).alias("skel"))


@query(f"WITH {sql.PREP} SELECT id, naddr FROM prep")
def norm_addresses(spark, d):
    return records(spark, d).select("id", n.norm_addr(F.col("addr")).alias("naddr"))


# Names as written, and what must come out.
ANY_SCRIPT = [("De\u0301pot Central", "depot central"), ("Vi\u1ec7t H\u01b0ng Ltd", "viet hung"), ("Bra\u0219ov", "brasov"), ("Łódź Øst Straße", "lodz ost strasse"), ("राम", "raama"), ("北京", "beijing"), ("Москва", "moskva"), ("서울", "seoul"), ("İzmir", "izmir")]


@query("SELECT n_nationkey, " + " ".join(["CASE n_nationkey", *(f"WHEN {i} THEN '{want}'" for i, (_, want) in enumerate(ANY_SCRIPT)), "ELSE trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) END"]) + " AS nname FROM nation")
def any_script_names(spark, d):
    """Names with composed and combining marks and in other scripts, planted over those of the first nations."""
    names = F.create_map(*[F.lit(x) for i, (name, _) in enumerate(ANY_SCRIPT) for x in (i, name)])
    name = F.coalesce(F.try_element_at(names, F.col("n_nationkey").cast("int")), "n_name")
    return table(spark, d, "nation").select("n_nationkey", n.norm_name(name).alias("nname"))


#: Words that the lists of both rules treat differently, before what the records have.
_EARLIER_NAME, _EARLIER_ADDR = "shri asso ", "sainte passage ile de france "


@query(f"WITH {sql.prep(n.EARLIER_LISTS, f""" planted AS (SELECT * REPLACE ('{_EARLIER_NAME}' || name AS name, '{_EARLIER_ADDR}' || addr AS addr) FROM records),""", "planted")} SELECT id, nname, naddr, skel FROM prep")
def norm_names_earlier(spark, d):
    """Names and addresses by the earlier rules' word lists."""
    planted = records(spark, d).withColumns({"name": F.concat(F.lit(_EARLIER_NAME), "name"), "addr": F.concat(F.lit(_EARLIER_ADDR), "addr")})
    return prepare(planted, lists=n.EARLIER_LISTS).select("id", "nname", "naddr", "skel")


@query(f"SELECT page_id, {sql.replace_all('lower(url)', n.DOMAIN, '.1').replace('.1', chr(92) + '1')} AS site, regexp_matches(url, {sql.quoted(n.HAS_DOMAIN)}) AS domain FROM pages")
def url_domains(spark, d):
    """Domain stripping and the domain flag on real URLs."""
    return table(spark, d, "pages").select("page_id", n.strip_domain(F.lower("url")).alias("site"), F.col("url").rlike(n.HAS_DOMAIN).alias("domain"))


@query(f"SELECT p_partkey, {sql.skeleton(sql.replace_all('lower(p_name)', '[^a-z0-9]+', ''))} AS skel FROM part")
def part_skeletons(spark, d):
    return table(spark, d, "part").select("p_partkey", n.skeleton(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "")).alias("skel"))


@query(f"WITH {sql.PREP} SELECT id, first_w, array_to_string(ntok, ' ') AS ntok, hn, array_to_string(nums, ' ') AS nums, array_to_string(atok, ' ') AS atok, postal, nonascii, domain, dba, noaddr, trim(name) || ' ; ' || trim(addr) AS raw FROM prep")
def prepared_records(spark, d):
    p = prepare(records(spark, d), keep_raw=True)
    return p.select("id", "first_w", *[F.array_join(c, " ").alias(c) for c in ("ntok",)], "hn", F.array_join("nums", " ").alias("nums"), F.array_join("atok", " ").alias("atok"), "postal", "nonascii", "domain", "dba", "noaddr", "raw")


@query(f"WITH {sql.RECORDS} SELECT country, source, count(*) AS n FROM records GROUP BY ALL")
def records_by_country(spark, d):
    return records(spark, d).groupBy("country", "source").agg(F.count("*").alias("n"))


# --- rarity and keys


@query(f"WITH {sql.RARE} SELECT country, token, df FROM rare_a_df")
def doc_frequency(spark, d):
    return rarity.doc_frequency(prepared(spark, d), "atok")


@query(f"WITH {sql.RARE} SELECT id, rn1, ra1, ra2 FROM rare")
def rarest_tokens(spark, d):
    return rarity.add_rarity(written(prepared(spark, d), "prepared")).select("id", "rn1", "ra1", "ra2")


@query(f"WITH {sql.RARE} SELECT id, {', '.join(CURRENT.keys)} FROM keyed")
def blocking_keys(spark, d):
    return keyed(spark, d).select("id", *CURRENT.keys)


@query(f"WITH {sql.blocks()} SELECT country, key_name, key, n_s, n_q FROM capped")
def capped_blocks(spark, d):
    return rarity.capped_blocks(rarity.long_keys(keyed(spark, d)))


@query(f"WITH {sql.blocks()} SELECT country, q_id, s1_id, key_name FROM key_pairs")
def key_pairs(spark, d):
    return blocking.key_pairs(keyed(spark, d))


@query(f"WITH {sql.blocks(EARLIER)} SELECT country, q_id, s1_id, key_name FROM key_pairs")
def key_pairs_earlier(spark, d):
    """The earlier rules' six keys and lower caps."""
    return blocking.key_pairs(keyed(spark, d), EARLIER)


# --- vector spaces and nearest neighbours


@query(f"WITH {sql.PREP}, {sql.NAMES} SELECT country, id, side, feature, round(w, 6) AS w FROM names")
def tfidf_names(spark, d):
    return rounded(tfidf.name_space(written(prepared(spark, d), "prepared")))


@query(f"WITH {sql.PREP}, {sql.ADDRESSES} SELECT country, id, side, feature, round(w, 6) AS w FROM addresses")
def tfidf_addresses(spark, d):
    return rounded(tfidf.address_space(written(prepared(spark, d), "prepared")))


def _spaces(spark, d):
    p = written(prepared(spark, d), "prepared")
    names, addresses = written(tfidf.name_space(p), "names"), written(tfidf.address_space(p), "addresses")
    return p, names, addresses


@query(f"WITH {sql.PREP}, {sql.NAMES}, {sql.ADDRESSES}, {sql.JOINT} SELECT country, id, side, feature, round(w, 6) AS w FROM joint")
def tfidf_joint(spark, d):
    _, names, addresses = _spaces(spark, d)
    return rounded(tfidf.joint_space(names, addresses))


@query(f"WITH {sql.PREP}, {sql.NAMES}, {sql.retrieval('names')} SELECT country, id, side, feature, round(w, 6) AS w FROM names_r")
def tfidf_retrieval(spark, d):
    """The name space without common features."""
    p = written(prepared(spark, d), "prepared")
    return rounded(tfidf.retrieval(tfidf.name_space(p), p))


@query(f"WITH {sql.PREP}, {sql.NAMES}, {sql.retrieval('names')}, {sql.nearest('names', CURRENT.knn_k_name, CURRENT.knn_min_name, 'knn')} SELECT * FROM knn")
def knn_names(spark, d):
    p = written(prepared(spark, d), "prepared")
    return tfidf.nearest(written(tfidf.retrieval(tfidf.name_space(p), p), "retrieval"), CURRENT.knn_k_name, CURRENT.knn_min_name)


@query(f"WITH {sql.PREP}, {sql.ADDRESSES}, {sql.retrieval('addresses')}, {sql.nearest('addresses', CURRENT.knn_k_addr, CURRENT.knn_min_addr, 'knn')} SELECT * FROM knn")
def knn_addresses(spark, d):
    p = written(prepared(spark, d), "prepared")
    return tfidf.nearest(written(tfidf.retrieval(tfidf.address_space(p), p), "retrieval"), CURRENT.knn_k_addr, CURRENT.knn_min_addr)


@query(f"WITH {sql.PREP}, {sql.NAMES}, {sql.ADDRESSES}, {sql.JOINT}, {sql.retrieval('joint')}, {sql.nearest('joint', CURRENT.knn_k, CURRENT.knn_min, 'knn')} SELECT * FROM knn")
def knn_joint(spark, d):
    p, names, addresses = _spaces(spark, d)
    return tfidf.nearest(written(tfidf.retrieval(tfidf.joint_space(names, addresses), p), "retrieval"), CURRENT.knn_k, CURRENT.knn_min)


@query(f"WITH {sql.candidates()} SELECT country, q_id, s1_id, in_knn, in_knn_name, in_knn_addr, {', '.join(CURRENT.keys)}, cos_all, cos_name, cos_addr FROM candidates")
def candidate_pairs(spark, d):
    """All channels together, one row a pair with its flags and cosines."""
    return blocking.candidates(keyed(spark, d))


# --- features


@query(f"WITH {sql.stage1()} SELECT country, q_id, s1_id, {', '.join(features.STAGE1)} FROM stage1")
def stage1_features(spark, d):
    k = keyed(spark, d)
    return rounded(features.stage1(written(blocking.candidates(k), "candidates"), k).select("country", "q_id", "s1_id", *features.STAGE1))


def _gathered(spark, d):
    k = keyed(spark, d)
    return features.gather(blocking.key_pairs(k).select("country", "q_id", "s1_id").distinct(), k, ["nname", "skel", "naddr", "hn", "nums", "postal"])


_NATIVE = {
    "lev_skel": "CASE WHEN greatest(length(a.skel), length(b.skel)) > 0 THEN 1 - levenshtein(a.skel, b.skel) / greatest(length(a.skel), length(b.skel))::DOUBLE ELSE 1.0::DOUBLE END",
    "hn_lev": "CASE WHEN a.hn <> '' AND b.hn <> '' THEN levenshtein(a.hn, b.hn) ELSE -1 END",
    "hn_suffix": "CAST(a.hn <> '' AND b.hn <> '' AND a.hn <> b.hn AND (ends_with(a.hn, b.hn) OR ends_with(b.hn, a.hn)) AS INTEGER)",
    "num_jac": "CASE WHEN len(a.nums) > 0 AND len(b.nums) > 0 THEN len(list_intersect(a.nums, b.nums)) / len(list_distinct(list_concat(a.nums, b.nums)))::DOUBLE ELSE 0.0::DOUBLE END",
    "num_contradiction": "CAST(len(a.nums) > 0 AND len(b.nums) > 0 AND len(list_intersect(a.nums, b.nums)) = 0 AS INTEGER)",
    "num_shared_cnt": "CASE WHEN len(a.nums) > 0 AND len(b.nums) > 0 THEN len(list_intersect(a.nums, b.nums)) ELSE 0 END",
    "post_contradiction": "CAST(a.postal <> '' AND b.postal <> '' AND a.postal <> b.postal AS INTEGER)",
    "tok_jac": f"CASE WHEN a.nname <> '' AND b.nname <> '' THEN len(list_intersect({sql.words('a.nname')}, {sql.words('b.nname')})) / len(list_distinct(list_concat({sql.words('a.nname')}, {sql.words('b.nname')})))::DOUBLE ELSE 0.0::DOUBLE END",
    "len_a": "length(a.nname)",
    "len_b": "length(b.nname)",
    "len_diff_ratio": "abs(length(a.nname) - length(b.nname)) / greatest(length(a.nname), length(b.nname), 1)::DOUBLE",
    "is_s2": "CAST(starts_with(p.q_id, 'S2-') AS INTEGER)",
    "is_s3": "CAST(starts_with(p.q_id, 'S3-') AS INTEGER)",
}
_PAIRS = "(SELECT DISTINCT country, q_id, s1_id FROM key_pairs) p JOIN prep a ON a.id = p.s1_id AND a.country = p.country JOIN prep b ON b.id = p.q_id AND b.country = p.country"


@query(f"WITH {sql.blocks()} SELECT p.country, p.q_id, p.s1_id, {', '.join(f'round({v}, 6) AS {k}' if 'DOUBLE' in v else f'CAST({v} AS INTEGER) AS {k}' for k, v in _NATIVE.items())} FROM {_PAIRS}")
def string_features_native(spark, d):
    g = _gathered(spark, d)
    made = features.native_strings(g)
    return rounded(g.withColumns({k: v if "DOUBLE" in _NATIVE[k] else v.cast("int") for k, v in made.items()}).select("country", "q_id", "s1_id", *made))


@query(f"WITH {sql.blocks()} SELECT p.country, p.q_id, p.s1_id, round(CASE WHEN a.nname = b.nname THEN 1.0 WHEN a.nname = '' OR b.nname = '' THEN 0.0 ELSE jaro_winkler_similarity(a.nname, b.nname) END, 5) AS jw_name, round(CASE WHEN a.skel = b.skel THEN 1.0 WHEN a.skel = '' OR b.skel = '' THEN 0.0 ELSE jaro_winkler_similarity(a.skel, b.skel) END, 5) AS jw_skel FROM {_PAIRS}")
def jaro_winkler(spark, d):
    g = _gathered(spark, d)
    return g.select("country", "q_id", "s1_id", F.round(similarity("jaro_winkler", F.col("a_nname"), F.col("b_nname")), 5).alias("jw_name"), F.round(similarity("jaro_winkler", F.col("a_skel"), F.col("b_skel")), 5).alias("jw_skel"))


@query()
def string_similarities(spark, d):
    """Ratio, token-sort, token-set and partial ratio; SQL has no common subsequence, tests hold them against plain versions."""
    g = _gathered(spark, d)
    one = lambda name, c: F.round(similarity(name, F.col(f"a_{c}"), F.col(f"b_{c}")), 6)
    return g.select("country", "q_id", "s1_id", one("ratio", "nname").alias("ratio_name"), one("token_set_ratio", "nname").alias("tset_name"), one("token_sort_ratio", "nname").alias("tsort_name"), one("partial_ratio", "nname").alias("partial_name"), one("ratio", "naddr").alias("ratio_addr"), one("token_set_ratio", "naddr").alias("tset_addr"), one("partial_ratio", "naddr").alias("partial_addr"))


_P = "pp AS MATERIALIZED (SELECT country, q_id, s1_id, cos_all, round(1 / (1 + exp(-logit)), 6) AS p1 FROM scored)"


def _with_p1(spark, d):
    return written(scored(spark, d).select("country", "q_id", "s1_id", "cos_all", F.round(decode.calibrated(F.col("logit"), 1.0, 0.0), 6).alias("p1")), "p1")


_Q, _S = "country, q_id", "country, s1_id"


@query(
    f"""WITH {sql.candidates()}, {SCORED}, {_P}, g AS (SELECT pp.*, b.skel, b.hn, CAST(p1 > 0.5 AS INTEGER) AS hi FROM pp JOIN prep b ON b.id = q_id AND b.country = pp.country)
SELECT country, q_id, s1_id, {sql.rank(_Q, "p1", "s1_id")} AS p1_q_rank, round({sql.margin(_Q, "p1", "s1_id")}, 6) AS p1_q_margin, round(p1 / greatest(sum(p1) OVER (PARTITION BY {_Q}), 1e-9), 6) AS p1_q_share,
{sql.rank(_S, "p1", "q_id")} AS p1_s_rank, count(*) OVER (PARTITION BY {_S}) AS p1_s_n, round({sql.margin(_S, "p1", "q_id")}, 6) AS p1_s_margin, {sql.rank(_S, "cos_all", "q_id")} AS s_rank, count(*) OVER (PARTITION BY {_S}) AS s_n,
round({sql.margin(_S, "cos_all", "q_id")}, 6) AS s_margin, CAST(sum(hi) OVER (PARTITION BY {_S}, skel) - hi AS BIGINT) AS skel_support, CAST(CASE WHEN hn <> '' THEN sum(hi) OVER (PARTITION BY {_S}, hn) - hi ELSE 0 END AS BIGINT) AS hn_support, CAST(sum(hi) OVER (PARTITION BY {_S}) - hi AS BIGINT) AS s_hi FROM g"""
)
def context_features(spark, d):
    """Ranks, margins, shares and support of a pair among those of its records."""
    return rounded(features.context(_with_p1(spark, d), prepared(spark, d)).drop("p1", "cos_all"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY user_id) AS n, round(" + sql.margin("user_id", "value", "event_id") + ", 6) AS margin, round(value / greatest(sum(value) OVER (PARTITION BY user_id), 1e-9), 6) AS share, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def group_context(spark, d):
    """Rank, size, margin, share and running sum of events among their user's."""
    key = ["user_id"]
    made = {"rank": windows.rank(key, "value", "event_id"), "n": windows.size(key), "margin": windows.margin(key, "value", "event_id"), "share": windows.share(key, "value"), "running": windows.running(key, "value", "event_id")}
    return rounded(table(spark, d, "events").select("event_id", "user_id", F.col("value")).withColumns(made).select("event_id", *made))


# --- truth, metrics, decisions


@query(f"WITH {sql.RECORDS}, {sql.TRUTH} SELECT s1_id, string_agg(q_id, ',' ORDER BY q_id) AS matched_entity_ids FROM truth GROUP BY ALL")
def truth_lists(spark, d):
    return truth(spark, d).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("q_id")), ",").alias("matched_entity_ids"))


@query(f"WITH {sql.RECORDS}, {sql.TRUTH} SELECT DISTINCT s1_id, q_id FROM truth")
def truth_unnest(spark, d):
    """Comma lists back to pairs; empty lists give none."""
    lists = id_lists(s1_ids(spark, d), truth(spark, d), "matched_entity_ids")
    return truth_pairs(lists)


@query("SELECT 'P' || l_partkey AS q_id, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def truth_owners(spark, d):
    """Collision audit, on pairs that aren't exclusive: parts with more than one supplier."""
    pairs = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("s1_id"), F.concat(F.lit("P"), "l_partkey").alias("q_id"))
    return metrics.owners(pairs)


@query(f"WITH {sql.candidates()}, {sql.TRUTH} SELECT c.country, c.q_id, c.s1_id, CAST(t.q_id IS NOT NULL AS INTEGER) AS y FROM candidates c LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.s1_id = c.s1_id AND t.q_id = c.q_id")
def labelled_pairs(spark, d):
    found = blocking.candidates(keyed(spark, d)).select("country", "q_id", "s1_id")
    return found.join(truth(spark, d).distinct().withColumn("y", F.lit(1)), ["s1_id", "q_id"], "left").select("country", "q_id", "s1_id", F.coalesce("y", F.lit(0)).alias("y"))


@query(f"WITH {sql.candidates()}, {sql.TRUTH} SELECT count(*) AS pairs, count(*) FILTER (hit) AS found, count(*) FILTER (hit) / count(*)::DOUBLE AS recall, (SELECT count(*) FROM (SELECT s1_id FROM f GROUP BY s1_id HAVING bool_or(hit))) AS any_entity, (SELECT count(*) FROM (SELECT s1_id FROM f GROUP BY s1_id HAVING bool_and(hit))) AS full_entity FROM f".replace("SELECT count(*) AS pairs", ", f AS (SELECT t.s1_id, t.q_id, c.q_id IS NOT NULL AS hit FROM (SELECT DISTINCT * FROM truth) t LEFT JOIN candidates c ON c.s1_id = t.s1_id AND c.q_id = t.q_id) SELECT count(*) AS pairs", 1))
def candidate_recall(spark, d):
    """Recall of candidates by pair and by entity."""
    return metrics.recall(blocking.candidates(keyed(spark, d)), truth(spark, d)).select(F.col("pairs"), "found", "recall", "any_entity", "full_entity")


_DECODED = f"WITH {sql.candidates()}, {SCORED}, {sql.decoded('scored', decode.Rule())}"


@query(f"{_DECODED} SELECT s1_id, q_id, round(p, 6) AS p FROM matches")
def select_matches(spark, d):
    return rounded(decode.select_matches(scored(spark, d)))


@query(f"WITH {sql.candidates()}, {SCORED}, {sql.decoded('scored', decode.EARLIER_RULE)} SELECT s1_id, q_id, round(p, 6) AS p FROM matches")
def select_matches_earlier(spark, d):
    """The earlier decision: no floor and no gate on the strongest pair."""
    return rounded(decode.select_matches(scored(spark, d), decode.EARLIER_RULE))


@query(f"{_DECODED}, {sql.TRUTH}, {sql.per_entity('matches')} SELECT s1_id, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_true AS BIGINT) AS n_true, CAST(tp AS BIGINT) AS tp, round(f05, 6) AS f05 FROM scored_entity")
def entity_f05(spark, d):
    return rounded(metrics.per_entity(s1_ids(spark, d), decode.select_matches(scored(spark, d)), truth(spark, d)))


@query(f"{_DECODED}, {sql.TRUTH}, {sql.per_entity('matches')} SELECT count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM scored_entity")
def macro_f05(spark, d):
    return rounded(metrics.macro_f05(s1_ids(spark, d), decode.select_matches(scored(spark, d)), truth(spark, d)))


@query(f"WITH {sql.candidates()}, {sql.TRUTH}, hit AS (SELECT DISTINCT c.s1_id, c.q_id FROM candidates c JOIN truth t ON t.s1_id = c.s1_id AND t.q_id = c.q_id), {sql.per_entity('hit')} SELECT count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM scored_entity")
def oracle_f05(spark, d):
    """The score of a perfect matcher on the candidates."""
    return rounded(metrics.oracle_f05(s1_ids(spark, d), blocking.candidates(keyed(spark, d)), truth(spark, d)))


@query(f"WITH {sql.candidates()}, {SCORED}, {sql.TRUTH}, plain AS (SELECT DISTINCT s1_id, q_id FROM scored WHERE logit > 0), {sql.per_entity('plain')} SELECT count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM scored_entity")
def naive_f05(spark, d):
    """The score of all pairs above one half, without one owner for each query record."""
    return rounded(metrics.macro_f05(s1_ids(spark, d), metrics.naive(scored(spark, d)), truth(spark, d)))


@query(f"{_DECODED}, {sql.TRUTH}, {sql.per_entity('matches')} SELECT country, count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM scored_entity JOIN records ON id = s1_id GROUP BY country")
def f05_by_country(spark, d):
    own = records(spark, d).where("source = 'S1'").select("country", F.col("id").alias("s1_id"))
    per = metrics.per_entity(own, decode.select_matches(scored(spark, d)), truth(spark, d))
    return rounded(per.join(own, "s1_id").groupBy("country").agg(F.count("*").alias("entities"), F.avg("f05").alias("macro_f05")))


_TAU = "tau AS (SELECT coalesce(list_sort(list(p1))[CAST(least(floor((1 - 0.9) * count(*)), count(*) - 1) AS BIGINT) + 1], 0) AS tau FROM pp JOIN (SELECT DISTINCT * FROM truth) t USING (s1_id, q_id))"


@query(f"WITH {sql.candidates()}, {SCORED}, {_P}, {sql.TRUTH}, {_TAU} SELECT round(tau, 6) AS tau FROM tau")
def prune_threshold(spark, d):
    """The score that keeps nine tenths of the true pairs."""
    y = truth(spark, d).distinct().withColumn("y", F.lit(1))
    return rounded(metrics.prune_threshold(_with_p1(spark, d).join(y, ["s1_id", "q_id"], "left"), 0.9))


_SAFE = f"q_rank = 1 OR skel_eq = 1 AND cos_name >= {CURRENT.safe_cos_name} OR k_skel = 1 OR k_name_sort = 1 OR k_nm_hn = 1 OR hn_eq = 1 AND ra1_eq = 1 OR cos_all >= {CURRENT.safe_cos_all}"


@query(f"WITH {sql.stage1()} SELECT country, q_id, s1_id FROM (SELECT *, round(1 / (1 + exp(-(12 * cos_all + 3 * cos_name - 7))), 6) AS p1 FROM stage1) WHERE p1 >= 0.6 OR {_SAFE}")
def pruned_pairs(spark, d):
    """Pairs that pass the threshold or the safety net."""
    k = keyed(spark, d)
    f = features.stage1(written(blocking.candidates(k), "candidates"), k)
    p1 = F.round(decode.calibrated(12 * F.col("cos_all") + 3 * F.col("cos_name") - 7, 1.0, 0.0), 6)
    return decode.prune(f.withColumn("p1", p1), 0.6).select("country", "q_id", "s1_id")


_RANKED = f"q AS MATERIALIZED (SELECT *, {sql.rank('country, q_id', 'p1', 's1_id')} AS rq, {sql.rank('country, s1_id', 'p1', 'q_id')} AS rs FROM pp)"


@query(f"WITH {sql.candidates()}, {SCORED}, {_P}, {_RANKED} SELECT country, q_id, s1_id FROM q WHERE p1 >= 0.9 OR rq <= 2 OR rs <= 3")
def pruned_by_rank(spark, d):
    """Pairs that pass the threshold or are among the best of either record."""
    return decode.prune(_with_p1(spark, d), 0.9, replace(CURRENT, safety_net=False, keep_q=2, keep_s=3)).select("country", "q_id", "s1_id")


@query(f"""WITH {sql.candidates()}, {SCORED}, {_P}, {_RANKED} SELECT country, q_id, s1_id, CAST(rq = 1 AS INTEGER) AS q_top, CAST(rs = 1 AS INTEGER) AS s_top, CAST(rq = 1 AND rs = 1 AS INTEGER) AS both_top1, CAST(rq <= 3 AND rs <= 3 AS INTEGER) AS both_top3,
CAST(sum(CAST(p1 > 0.5 AS INTEGER)) OVER w AS BIGINT) AS s_over_50, CAST(sum(CAST(p1 > 0.8 AS INTEGER)) OVER w AS BIGINT) AS s_over_80, CAST(sum(CAST(p1 > 0.95 AS INTEGER)) OVER w AS BIGINT) AS s_over_95 FROM q WINDOW w AS (PARTITION BY country, s1_id)""")
def reciprocal_features(spark, d):
    """Whether both records see each other as best, and how many strong pairs an S1 record has."""
    return features.reciprocal(_with_p1(spark, d)).drop("p1", "cos_all")


# --- diagnosis

_JUDGED = """judged AS MATERIALIZED (SELECT *, round(1 / (1 + exp(-logit0)), 6) AS p, round(1 / (1 + exp(-logit)), 6) AS final FROM (
  SELECT *, round(logit0 + 0.5 * coalesce(ce, 0), 6) AS logit FROM (SELECT country, s1_id, q_id, logit AS logit0, CASE WHEN abs(logit) < 3 THEN round(8 * cos_addr - 3, 6) END AS ce FROM scored)))"""
_KINDS = f"""WITH {sql.candidates()}, {SCORED}, {sql.TRUTH}, {_JUDGED}, {sql.decoded('judged', decode.Rule())}, t AS (SELECT DISTINCT s1_id, q_id FROM truth),
wrong AS (SELECT coalesce(t.s1_id, m.s1_id) AS s1_id, coalesce(t.q_id, m.q_id) AS q_id, t.s1_id IS NOT NULL AS missed FROM t FULL JOIN matches m ON m.s1_id = t.s1_id AND m.q_id = t.q_id WHERE t.s1_id IS NULL OR m.s1_id IS NULL),
kinds AS MATERIALIZED (SELECT w.s1_id, w.q_id, j.p, j.final, j.ce, CASE WHEN missed AND c.s1_id IS NULL THEN 'blocker_miss' WHEN missed AND coalesce(j.p, 0) < 0.05 THEN 'prune_miss' WHEN missed AND j.final >= 0.5 THEN 'decoder_miss' WHEN missed AND j.p >= 0.5 THEN 'fusion_miss' WHEN missed AND j.ce < 0 THEN 'ce_miss' WHEN missed THEN 'structured_miss'
  WHEN w.s1_id NOT IN (SELECT s1_id FROM t) THEN 'singleton_wrong' WHEN w.q_id IN (SELECT q_id FROM t) THEN 'owner_wrong' WHEN j.p < 0.5 THEN 'fusion_wrong' WHEN j.ce > 0 THEN 'ce_wrong' ELSE 'structured_wrong' END AS kind
  FROM wrong w LEFT JOIN candidates c ON c.s1_id = w.s1_id AND c.q_id = w.q_id LEFT JOIN judged j ON j.s1_id = w.s1_id AND j.q_id = w.q_id)"""


def _errors(spark, d, s: DataFrame | None = None) -> DataFrame:
    s = scored(spark, d) if s is None else s
    ce = F.when(F.abs("logit") < 3, F.round(8 * F.col("cos_addr") - 3, 6))
    p = lambda c: F.round(decode.calibrated(F.col(c), 1.0, 0.0), 6)
    both = s.select("s1_id", "q_id", F.col("logit").alias("logit0"), ce.alias("ce")).withColumn("logit", F.round(decode.fused(F.col("logit0"), F.col("ce"), 0.5), 6))
    judged = written(both.withColumns({"p": p("logit0"), "final": p("logit")}), "judged")
    return diagnosis.errors(truth(spark, d), s, judged.where("p >= 0.05"), judged, decode.select_matches(judged))


@query(f"{_KINDS} SELECT s1_id, q_id, kind, p, final, ce FROM kinds")
def error_kinds(spark, d):
    """Every error with the step that made it."""
    return _errors(spark, d)


@query(f"{_KINDS} SELECT kind, count(*) AS n FROM kinds GROUP BY kind")
def error_counts(spark, d):
    return diagnosis.error_counts(_errors(spark, d))


@query(f"{_KINDS} SELECT s1_id, q_id, kind, p, final, ce, CAST(row_number() OVER w AS INTEGER) AS place FROM kinds WINDOW w AS (PARTITION BY kind ORDER BY CASE WHEN ends_with(kind, '_wrong') THEN -coalesce(final, 0) ELSE coalesce(final, 0) END, s1_id, q_id) QUALIFY row_number() OVER w <= 20")
def hardest_errors(spark, d):
    """The twenty errors of each kind that the score is most wrong about."""
    return diagnosis.hardest(_errors(spark, d), 20)


@query(f"""{_KINDS.replace(sql.candidates(), sql.stage1(), 1)} SELECT kind, g AS "group", count(*) AS n FROM (SELECT kind, unnest([CASE WHEN dba_b = 1 THEN 'dba' END, CASE WHEN nonascii_a = 1 OR nonascii_b = 1 THEN 'non_ascii' END, CASE WHEN cos_name >= 0.7 AND cos_addr < 0.3 THEN 'name_only' END,
  CASE WHEN cos_addr >= 0.7 AND cos_name < 0.3 THEN 'address_only' END, CASE WHEN hn_both = 1 AND hn_eq = 0 THEN 'other_number' END]) AS g FROM kinds k JOIN stage1 s ON s.s1_id = k.s1_id AND s.q_id = k.q_id) WHERE g IS NOT NULL GROUP BY ALL""")
def error_groups(spark, d):
    """Errors of each kind by groups of pairs."""
    k = keyed(spark, d)
    f = written(features.stage1(written(blocking.candidates(k), "candidates"), k), "stage1")
    s = f.withColumn("logit", F.round(12 * F.col("cos_all") + 3 * F.col("cos_name") - 7, 6))
    return diagnosis.error_groups(_errors(spark, d, s), f)


_LABELLED = f"labelled AS MATERIALIZED (SELECT s.*, CAST(t.q_id IS NOT NULL AS INTEGER) AS y, round(1 / (1 + exp(-round(12 * cos_all + 3 * cos_name - 7, 6))), 6) AS p1 FROM stage1 s LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.s1_id = s.s1_id AND t.q_id = s.q_id)"


def _labelled_scored(spark, d) -> DataFrame:
    logit = F.round(12 * F.col("cos_all") + 3 * F.col("cos_name") - 7, 6)
    return written(_labelled_features(spark, d).withColumn("p1", F.round(decode.calibrated(logit, 1.0, 0.0), 6)), "judged")


@query(f"""WITH {sql.stage1()}, {sql.TRUTH}, {_LABELLED}, f AS (SELECT country, s1_id, q_id, CAST(row_number() OVER (PARTITION BY country, q_id ORDER BY p1 DESC, s1_id) = 1 AS INTEGER) AS top_owner, CAST(row_number() OVER (PARTITION BY country, s1_id ORDER BY p1 DESC, q_id) = 1 AS INTEGER) AS top_query,
  CAST(skel_eq = 1 AS INTEGER) AS same_name, CAST(p1 >= 0.5 AS INTEGER) AS high_score, CAST(cos_name >= 0.7 AND cos_addr < 0.3 AS INTEGER) AS name_only, CAST(cos_addr >= 0.7 AND cos_name < 0.3 AS INTEGER) AS address_only, CAST(hn_both = 1 AND hn_eq = 0 AS INTEGER) AS other_number FROM labelled WHERE y = 0)
SELECT * FROM f WHERE top_owner + top_query + same_name + high_score + name_only + address_only + other_number > 0""")
def hard_negatives(spark, d):
    """Wrong pairs worth learning from, by category."""
    return diagnosis.hard_negatives(_labelled_scored(spark, d))


@query(f"""WITH {sql.stage1()}, {sql.TRUTH}, {_LABELLED}, b AS (SELECT CAST(substr(q_id, 1, 2) AS VARCHAR) AS source, CAST(least(floor(cos_name * 5), 4) AS INTEGER) AS bin, count(*) FILTER (y = 1) AS matches, count(*) FILTER (y = 0) AS others FROM labelled GROUP BY ALL)
SELECT source, bin, matches, others, round(ln((matches / greatest(sum(matches) OVER w, 1)::DOUBLE + 0.001) / (others / greatest(sum(others) OVER w, 1)::DOUBLE + 0.001)), 6) AS llr FROM b WINDOW w AS (PARTITION BY source)""")
def source_evidence(spark, d):
    """How much a bin of name similarity tells, by source."""
    return rounded(diagnosis.evidence(_labelled_scored(spark, d), F.substring("q_id", 1, 2), F.least(F.floor(F.col("cos_name") * 5), F.lit(4)).cast("int")))


_TRADE = "CASE WHEN doc_id % 2 = 0 THEN array_to_string(string_split(name, ' ')[1:2], ' ') || ' dba ' || array_to_string(string_split(name, ' ')[3:4], ' ') ELSE name END"
_NORMED = lambda x: f"coalesce(array_to_string(list_filter({sql.words(sql.replace_all(sql.fold(x), '[^a-z0-9]+', ' '))}, lambda t: NOT list_contains({sql.strings(n.LEGAL)}, t)), ' '), '')"
_CROSS = {f"{x}_{y}": f"CASE WHEN a.{x} = '' OR b.{y} = '' THEN 0.0::DOUBLE WHEN a.{x} = b.{y} THEN 1.0::DOUBLE ELSE jaro_winkler_similarity(a.{x}, b.{y}) END" for x in ("legal", "trade") for y in ("legal", "trade")}


@query(f"""WITH {sql.blocks()}, named2 AS (SELECT country, id, {_TRADE} AS x FROM prep),
two AS MATERIALIZED (SELECT country, id, {_NORMED(f"regexp_replace(x, {sql.quoted(n.HAS_DBA + '(?s:.*)$')}, '')")} AS legal, {_NORMED(f"CASE WHEN regexp_matches(x, {sql.quoted(n.HAS_DBA)}) THEN regexp_replace(x, {sql.quoted(n.DBA)}, '') ELSE '' END")} AS trade FROM named2)
SELECT p.country, p.q_id, p.s1_id, {', '.join(f'round({v}, 5) AS {k}' for k, v in _CROSS.items())}, round(greatest({', '.join(_CROSS.values())}), 5) AS dba_sim FROM (SELECT DISTINCT country, q_id, s1_id FROM key_pairs) p JOIN two a ON a.id = p.s1_id AND a.country = p.country JOIN two b ON b.id = p.q_id AND b.country = p.country""")
def cross_names(spark, d):
    """Legal and trade names of both sides against each other; every second record gets a marker between its words."""
    k = keyed(spark, d)
    words, number = F.split("name", " "), F.substring_index("id", "-", -1).cast("long")
    part = lambda i, m: F.array_join(F.slice(words, i, m), " ")
    named = k.select("country", "id", "source", F.when(number % 2 == 0, F.concat(part(1, 2), F.lit(" dba "), part(3, 2))).otherwise(F.col("name")).alias("name"))
    g = features.gather(blocking.key_pairs(k).select("country", "q_id", "s1_id").distinct(), named, ["name"])
    out = features.cross_names(g).drop("a_name", "b_name")
    return out.select("country", "q_id", "s1_id", *[F.round(c, 5).alias(c) for c in (*_CROSS, "dba_sim")])


@query(f"{_DECODED} SELECT id AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM records LEFT JOIN (SELECT s1_id, string_agg(q_id, ',' ORDER BY q_id) AS l FROM matches GROUP BY ALL) ON s1_id = id WHERE source = 'S1'")
def matching_results(spark, d):
    """One row for each S1 record with its sorted matches, empty if there are none."""
    return id_lists(s1_ids(spark, d), decode.select_matches(scored(spark, d)), "matched_entity_ids")


@query(f"WITH {sql.candidates()}, {SCORED} SELECT country, q_id, s1_id, round(logit + 0.5 * CASE WHEN abs(logit) < 3 THEN cos_name ELSE 0 END, 7) AS logit FROM scored")
def fused_scores(spark, d):
    """A second score added where the first is unsure, 0 elsewhere."""
    s = scored(spark, d)
    ce = F.when(F.abs("logit") < CURRENT.ce_margin, F.col("cos_name"))
    return s.select("country", "q_id", "s1_id", F.round(decode.fused(F.col("logit"), ce, 0.5), 7).alias("logit"))


@query("SELECT doc_id, round((p1 + p2 + p3) / 3, 6) AS p FROM (SELECT doc_id, (doc_id % 7) / 7.0::DOUBLE AS p1, (doc_id % 5) / 5.0::DOUBLE AS p2, (doc_id % 3) / 3.0::DOUBLE AS p3 FROM documents)")
def ensemble_mean(spark, d):
    docs = table(spark, d, "documents").select("doc_id", *[(F.pmod("doc_id", F.lit(k)) / float(k)).alias(f"p{k}") for k in (7, 5, 3)])
    return rounded(docs.select("doc_id", ((F.col("p7") + F.col("p5") + F.col("p3")) / 3).alias("p")))


# --- samples


def _u(seed: int, key: str) -> str:
    return f"((CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)"


@query(f"SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_u(42, 'c_custkey')}, c_custkey) <= round(0.25 * count(*) OVER (PARTITION BY c_mktsegment))")
def exact_sample(spark, d):
    """A quarter of each segment's customers, exactly."""
    return sampling.exact_fraction(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 0.25, 42, "c_custkey", "c_mktsegment")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, ln({_u(7, 'o_orderkey')}) / (0.05 + 4 * p * (1 - p)) AS k FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS p FROM orders)) ORDER BY k DESC, o_orderkey LIMIT 500")
def weighted_sample(spark, d):
    """500 orders without replacement, the unsure ones likelier."""
    p = (F.pmod("o_orderkey", F.lit(101)) / 100.0).alias("p")
    rows = table(spark, d, "orders").select("o_orderkey", p)
    return sampling.weighted(rows, 500, sampling.uncertainty(F.col("p")), 7, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, CAST(CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS INTEGER) AS fold FROM orders")
def hash_folds(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sampling.fold("o_orderkey", CURRENT.folds).alias("fold"))


@query(f"WITH {sql.RECORDS}, {sql.TRUTH}, own AS (SELECT country, id AS s1_id, coalesce(n, 0) AS matches FROM records LEFT JOIN (SELECT s1_id, CAST(least(count(DISTINCT q_id), 3) AS INTEGER) AS n FROM truth GROUP BY s1_id) ON s1_id = id WHERE source = 'S1') SELECT s1_id, country, matches, CAST((row_number() OVER (PARTITION BY country, matches ORDER BY {_u(42, 's1_id')}, s1_id) - 1) % 5 AS INTEGER) AS fold FROM own")
def stratified_folds(spark, d):
    """Five folds of S1 records that are alike in country and number of matches."""
    own = records(spark, d).where("source = 'S1'").select("country", F.col("id").alias("s1_id"))
    return sampling.stratified_folds(metrics.cardinality(own, truth(spark, d)), ["country", "matches"], 5, 42, "s1_id").select("s1_id", "country", "matches", "fold")


@query(f"WITH {sql.candidates()}, {SCORED} SELECT country, q_id, s1_id FROM scored QUALIFY row_number() OVER (PARTITION BY country ORDER BY abs(logit), q_id, s1_id) <= 100")
def most_uncertain(spark, d):
    """The hundred least certain pairs of each country."""
    return sampling.most_uncertain(scored(spark, d), 100, "country", "logit", ["q_id", "s1_id"]).select("country", "q_id", "s1_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_with_urgent(spark, d):
    """Semi-join membership."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_urgent(spark, d):
    """Anti-join distractors."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def supplier_totals(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_orders(spark, d):
    """Three best per group."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(order)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


# --- dense vectors


@query("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 5) AS emb_cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, d):
    v = table(spark, d, "embeddings")
    pairs = v.select(F.col("vec_id").alias("a_id"), (F.col("vec_id") + 1).alias("b_id"))
    out = dense.pair_cosine(pairs, v, "a_id", "b_id")
    return out.select("a_id", "b_id", F.round("emb_cos", 5).alias("emb_cos"))


@query("SELECT label, round(x, 6) AS x, CAST(i - 1 AS INTEGER) AS i FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL)")
def mean_embeddings(spark, d):
    """Mean vector of each label, one row a component."""
    pooled = dense.mean_pool(table(spark, d, "embeddings"), "label")
    return rounded(pooled.select("label", F.posexplode("vector").alias("i", "x")))


_DISTINCT = "d AS MATERIALIZED (SELECT DISTINCT country, q_id, s1_id FROM key_pairs)"


@query(
    f"""WITH {sql.blocks()}, {_DISTINCT}, x AS (SELECT country, id, trim(name) AS x FROM prep),
g AS (SELECT country, id, CAST(('0x' || substr(md5(substr(x, CAST(i AS INTEGER), 3)), 1, 6)) AS BIGINT) % {embedding.DIMENSIONS} AS place, count(*) AS c FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM x) GROUP BY country, id, place),
n AS (SELECT country, id, sqrt(sum(c * c)) AS n FROM g GROUP BY ALL), s AS (SELECT d.country, d.q_id, d.s1_id, sum(a.c * b.c) AS s FROM d JOIN g a ON a.id = d.s1_id AND a.country = d.country JOIN g b ON b.id = d.q_id AND b.country = d.country AND b.place = a.place GROUP BY ALL)
SELECT d.country, d.q_id, d.s1_id, round(coalesce(s.s / (a.n * b.n), 0), 5) AS emb_cos FROM d LEFT JOIN s ON s.country = d.country AND s.q_id = d.q_id AND s.s1_id = d.s1_id LEFT JOIN n a ON a.id = d.s1_id AND a.country = d.country LEFT JOIN n b ON b.id = d.q_id AND b.country = d.country"""
)
def name_embeddings(spark, d):
    """Cosines of names by an encoder whose vectors are kept by content."""
    k = keyed(spark, d)
    pairs = blocking.key_pairs(k).select("country", "q_id", "s1_id").distinct()
    out = embedding.name_cosines(pairs, k, folder=f"{folder(spark)}/vectors")
    return out.select("country", "q_id", "s1_id", F.round("emb_cos", 5).alias("emb_cos"))


# --- pairs of texts


def _pair_texts(spark, d) -> DataFrame:
    raw = prepare(records(spark, d), keep_raw=True)
    pairs = blocking.key_pairs(keyed(spark, d)).select("country", "q_id", "s1_id").distinct()
    y = truth(spark, d).distinct().withColumn("y", F.lit(1))
    return crosspair.texts(pairs, raw).join(y, ["s1_id", "q_id"], "left").fillna(0, ["y"])


@query(f"WITH {sql.blocks()}, {_DISTINCT}, {sql.TRUTH} SELECT d.country, d.q_id, d.s1_id, trim(a.name) || ' ; ' || trim(a.addr) AS a_raw, trim(b.name) || ' ; ' || trim(b.addr) AS b_raw, CAST(t.q_id IS NOT NULL AS INTEGER) AS y FROM d JOIN prep a ON a.id = d.s1_id AND a.country = d.country JOIN prep b ON b.id = d.q_id AND b.country = d.country LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.s1_id = d.s1_id AND t.q_id = d.q_id")
def pair_dataset(spark, d):
    """Both records' texts of each pair with its label, as a pair scorer learns from them."""
    return _pair_texts(spark, d).select("country", "q_id", "s1_id", "a_raw", "b_raw", "y")


@query()
def pair_scores(spark, d):
    """A trained pair scorer's log-odds in the zone of unsure pairs, 0 elsewhere; no SQL; a test walks its weights."""
    rows = written(_pair_texts(spark, d), "pairs")
    scorer = crosspair.fit(rows.withColumn("p1", F.lit(0.5)))
    logits = rows.select("country", "q_id", "s1_id", (F.pmod(F.xxhash64("q_id", "s1_id"), F.lit(1001)) / 100.0 - 5).alias("logit"))
    return rounded(crosspair.rescored(logits, prepare(records(spark, d), keep_raw=True), scorer))


# --- validation


_LISTS = "lists AS (SELECT 'S1-' || (conv_id % 60) AS s1_id, list_transform(range(0, turn % 4), lambda i: CASE WHEN (conv_id + i) % 11 = 0 THEN 'X-' ELSE 'S' || (2 + (conv_id + i) % 2) || '-' END || ((conv_id + CAST(floor(i / 2) AS BIGINT)) % 50)) AS ids FROM conversations)"


def _lists(spark, d):
    i = lambda x: (F.col("conv_id") + x).cast("long")
    one = lambda x: F.concat(F.when(F.pmod(i(x), F.lit(11)) == 0, F.lit("X-")).otherwise(F.concat(F.lit("S"), 2 + F.pmod(i(x), F.lit(2)), F.lit("-"))), F.pmod(F.col("conv_id") + F.floor(x / 2), F.lit(50)))
    ids = F.when(F.col("turn") % 4 > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("turn") % 4 - 1, F.lit(0))), one)).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select(F.concat(F.lit("S1-"), F.pmod("conv_id", F.lit(60))).alias("s1_id"), ids.alias("ids"))


def _five(rows: str) -> str:
    return f"(SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT e FROM {rows} ORDER BY e LIMIT 5))"


def _one(code: str, rows: str) -> str:
    return f"SELECT '{code}' AS code, (SELECT count(*) FROM {rows}) AS n, {_five(rows)} AS examples"


@query(
    f"""WITH {_LISTS}, required AS (SELECT 'S1-' || unnest(range(0, 70)) AS id), known AS (SELECT 'S2-' || unnest(range(0, 45)) AS id UNION ALL SELECT 'S3-' || unnest(range(0, 45))),
each AS (SELECT s1_id, unnest(ids) AS e FROM lists), f1 AS (SELECT s1_id AS e FROM lists GROUP BY ALL HAVING count(*) > 1), f2 AS (SELECT s1_id AS e FROM lists WHERE len(ids) <> len(list_distinct(ids))),
f3 AS (SELECT e FROM each WHERE NOT starts_with(e, 'S2-') AND NOT starts_with(e, 'S3-') AND NOT starts_with(e, 'S1-')), f4 AS (SELECT id AS e FROM required WHERE id NOT IN (SELECT s1_id FROM lists)),
f5 AS (SELECT DISTINCT s1_id AS e FROM lists WHERE s1_id NOT IN (SELECT id FROM required)), f6 AS (SELECT DISTINCT e FROM each WHERE e NOT IN (SELECT id FROM known)), f7 AS (SELECT e FROM each WHERE starts_with(e, 'S1-'))
SELECT * FROM ({" UNION ALL ".join(_one(c, r) for c, r in (("duplicate_row", "f1"), ("repeated_id", "f2"), ("self_match", "f7"), ("bad_prefix", "f3"), ("missing_entity", "f4"), ("extra_entity", "f5"), ("unknown_id", "f6")))}) WHERE n > 0"""
)
def list_findings(spark, d):
    """What is wrong with id lists."""
    required = spark.range(70).select(F.concat(F.lit("S1-"), "id").alias("id"))
    known = spark.range(45).select(F.explode(F.array(F.concat(F.lit("S2-"), "id"), F.concat(F.lit("S3-"), "id"))).alias("id"))
    return validate.findings(_lists(spark, d), required, known)


@query(f"WITH {_LISTS} SELECT count(*) AS rows, count(*) FILTER (len(ids) = 0) AS empties, CAST(sum(len(ids)) AS BIGINT) AS ids, count(DISTINCT s1_id) AS entities FROM lists")
def list_totals(spark, d):
    return validate.totals(_lists(spark, d))


# --- models


#: Few shallow trees: the catalogue shows the operator, not the best model.
QUICK = replace(CURRENT, trees=5, depth=3)


def _labelled_features(spark, d) -> DataFrame:
    k = keyed(spark, d)
    f = features.stage1(written(blocking.candidates(k), "candidates"), k)
    y = truth(spark, d).distinct().withColumn("y", F.lit(1))
    return written(f.join(y, ["s1_id", "q_id"], "left").fillna(0, ["y"]), "labelled")


@query()
def stage1_model(spark, d):
    """Out-of-fold scores of a boosted-tree classifier; no SQL; tests hold its scores against a plain walk of the trees."""
    from tessera.plans.model import out_of_fold

    rows = out_of_fold(_labelled_features(spark, d), features.STAGE1, QUICK)
    return rows.select("country", "q_id", "s1_id", "y", F.round("p1", 6).alias("p1"))


@query()
def resolved(spark, d):
    """Two-stage resolution from records to matches, scored by the out-of-fold models."""
    from tessera.plans.resolve import resolve

    return rounded(resolve(keyed(spark, d), truth(spark, d), QUICK))
