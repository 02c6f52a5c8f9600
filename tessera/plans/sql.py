"""The operators in DuckDB's SQL, written independently of the Spark plans, for the catalogue's oracle."""

from __future__ import annotations

from functools import reduce

from tessera.config import CURRENT, Config
from tessera.functions import normalize as n


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def fold(x: str) -> str:
    """Lower case without accents, by the engine's own rule."""
    return f"replace(replace(replace(strip_accents(lower(coalesce({x}, ''))), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def replace_all(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"


def skeleton(x: str) -> str:
    merged = reduce(lambda s, ab: f"replace({s}, {quoted(ab[0])}, {quoted(ab[1])})", n.MERGES, x)
    bare = replace_all(merged, "[aeiouy]", "")
    return f"list_aggregate(list_transform([{bare}], lambda z: coalesce(array_to_string(list_transform(range(1, length(z) + 1), lambda i: CASE WHEN i > 1 AND substr(z, CAST(i AS INTEGER), 1) = substr(z, CAST(i - 1 AS INTEGER), 1) THEN '' ELSE substr(z, CAST(i AS INTEGER), 1) END), ''), '')), 'first')"


RECORDS = f"""records AS MATERIALIZED (
  SELECT * EXCLUDE (keep) FROM (
    SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS id, 'S' || (doc_id % 3 + 1) AS source, coalesce(lang, '') AS country,
           array_to_string(w[1:4], ' ') AS name,
           concat_ws(' ', array_to_string(w[5:10], ' '), CAST(n_chars AS VARCHAR)) AS addr, doc_id,
           doc_id % 3 <> 0 OR doc_id = min(doc_id) OVER (PARTITION BY doc_id % 3, coalesce(lang, ''), coalesce(text, '')) AS keep
    FROM (SELECT *, {words(replace_all("coalesce(text, '')", "[ \\t\\n\\r]+", " "))} AS w FROM documents)) WHERE keep)"""

def prep(lists: n.Lists = n.LISTS, planted: str = "", base: str = "records") -> str:
    """Prepared records of `base` by a set of word lists; planted: its definition where it isn't the records themselves."""
    keys, values = strings(k for k, _ in lists.short), strings(v for _, v in lists.short)
    phrased = reduce(lambda s, ab: f"replace({s}, {quoted(f' {ab[0]} ')}, {quoted(f' {ab[1]} ')})", lists.phrases, f"' ' || {replace_all(fold('addr'), '[^a-z0-9]+', ' ')} || ' '")
    step3 = replace_all(f"trim({replace_all(replace_all(replace_all(fold(f'regexp_replace(name, {quoted(n.DBA)}, {quoted("")})'), n.DOMAIN, r'\1'), n.NOISE, ' '), '[^a-z0-9]+', ' ')})", lists.honorific, "")
    return f"""{RECORDS},{planted}
named AS MATERIALIZED (
  SELECT *, {words("joined")} AS jw FROM (
    SELECT *, array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i = 1 THEN t[i] WHEN regexp_full_match(t[i], '[a-z]') AND regexp_full_match(t[i - 1], '[a-z]') THEN t[i] ELSE ' ' || t[i] END), '') AS joined
    FROM (SELECT *, {words(step3)} AS t FROM {base}))),
addressed AS MATERIALIZED (
  SELECT * EXCLUDE (t, joined, jw, a), coalesce(array_to_string(nt, ' '), '') AS nname,
         coalesce(array_to_string(list_transform(list_filter(a, lambda x: NOT list_contains({strings(n.ADDRESS_STOPS)}, x)), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), ' '), '') AS naddr
  FROM (SELECT *, list_filter(jw, lambda x: NOT list_contains({strings(lists.legal)}, x)) AS nt,
               list_transform({words(phrased)}, lambda x: coalesce({values}[list_position({keys}, x)], x)) AS a FROM named)),
prep AS MATERIALIZED (
  SELECT id, source, country, name, addr, doc_id, nname, naddr, {skeleton("replace(nname, ' ', '')")} AS skel,
         coalesce(array_to_string(list_sort(nt), ' '), '') AS name_sort,
         CASE WHEN len(nt) > 1 THEN array_to_string(list_transform(nt, lambda x: substr(x, 1, 1)), '') ELSE '' END AS acronym,
         coalesce(nt[1], '') AS first_w,
         list_filter(list_transform(nt, lambda x: {skeleton("x")}), lambda x: length(x) >= 2) AS ntok,
         coalesce(num[1], '') AS hn, list_sort(list_distinct(num)) AS nums,
         list_filter(parts, lambda x: NOT regexp_full_match(x, '[0-9]+') AND length(x) >= 3) AS atok,
         coalesce(list_filter(num, lambda x: length(x) IN (5, 6))[-1], '') AS postal,
         regexp_matches(name, '[^\\x00-\\x7F]') AS nonascii, regexp_matches(name, {quoted(n.HAS_DOMAIN)}) AS domain,
         regexp_matches(name, {quoted(n.HAS_DBA)}) AS dba, naddr = '' AS noaddr
  FROM (SELECT *, list_filter(parts, lambda x: regexp_full_match(x, '[0-9]+')) AS num FROM (SELECT *, {words("naddr")} AS parts FROM addressed)))"""


PREP = prep()


def _rarest(tokens: str, names: tuple[str, ...], out: str) -> str:
    picks = ", ".join(f"coalesce(max(CASE WHEN r = {i + 1} THEN token END), '') AS {c}" for i, c in enumerate(names))
    return f"""{out}_long AS (SELECT country, id, unnest(list_distinct({tokens})) AS token FROM prep),
{out}_df AS (SELECT country, token, count(*) AS df FROM {out}_long GROUP BY ALL),
{out} AS MATERIALIZED (SELECT id, {picks} FROM (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY df, token) AS r FROM {out}_long JOIN {out}_df USING (country, token)) GROUP BY id)"""


def _joined(a: str, b: str, second: str | None = None) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN {a} || '|' || {second or b} ELSE '' END"


RARE = f"""{PREP},
{_rarest("ntok", ("rn1",), "rare_n")},
{_rarest("atok", ("ra1", "ra2"), "rare_a")},
rare AS MATERIALIZED (SELECT prep.*, coalesce(rn1, '') AS rn1, coalesce(ra1, '') AS ra1, coalesce(ra2, '') AS ra2 FROM prep LEFT JOIN rare_n USING (id) LEFT JOIN rare_a USING (id)),
keyed AS MATERIALIZED (
  SELECT *, CASE WHEN length(skel) >= 4 THEN skel ELSE '' END AS k_skel, CASE WHEN length(name_sort) >= 4 THEN name_sort ELSE '' END AS k_name_sort,
         CASE WHEN length(nname) >= 4 THEN nname ELSE '' END AS k_name_clean, {_joined("hn", "ra1")} AS k_hn_st,
         CASE WHEN ra1 <> '' AND ra2 <> '' THEN least(ra1, ra2) || '|' || greatest(ra1, ra2) ELSE '' END AS k_st2,
         {_joined("rn1", "ra1")} AS k_nm_st, {_joined("rn1", "hn")} AS k_nm_hn, {_joined("postal", "skel", "substr(skel, 1, 3)")} AS k_post_nm,
         {_joined("postal", "ra1")} AS k_post_ra1, {_joined("first_w", "hn")} AS k_first_hn FROM rare)"""


def blocks(cfg: Config = CURRENT) -> str:
    rows = " UNION ALL ".join(f"SELECT country, id, CASE WHEN source = 'S1' THEN 's' ELSE 'q' END AS side, '{k}' AS key_name, {k} AS key FROM keyed WHERE {k} <> ''" for k in cfg.keys)
    return f"""{RARE},
long_keys AS MATERIALIZED ({rows}),
capped AS MATERIALIZED (SELECT country, key_name, key, count(*) FILTER (side = 's') AS n_s, count(*) FILTER (side = 'q') AS n_q FROM long_keys GROUP BY ALL
  HAVING count(*) FILTER (side = 's') BETWEEN 1 AND {cfg.key_cap_s1} AND count(*) FILTER (side = 'q') BETWEEN 1 AND {cfg.key_cap_q}),
key_pairs AS MATERIALIZED (SELECT q.country, q.id AS q_id, s.id AS s1_id, q.key_name FROM long_keys q JOIN capped USING (country, key_name, key) JOIN long_keys s USING (country, key_name, key) WHERE q.side = 'q' AND s.side = 's')"""


def _space(out: str, features: str, base: str = "prep") -> str:
    return f"""{out}_c AS (SELECT country, id, side, feature, count(*) AS c FROM (SELECT country, id, CASE WHEN source = 'S1' THEN 's' ELSE 'q' END AS side, unnest({features}) AS feature FROM {base}) GROUP BY ALL),
{out}_df AS (SELECT country, feature, count(*) AS df FROM {out}_c GROUP BY ALL HAVING count(*) >= 2),
{out}_w AS (SELECT c.country, id, side, feature, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM {out}_c c JOIN {out}_df USING (country, feature) JOIN (SELECT country, CAST(count(*) AS DOUBLE) AS n FROM {base} GROUP BY ALL) t ON t.country = c.country),
{_unit(out + "_w", out)}"""


def _unit(source: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT * EXCLUDE (w), w / sqrt(sum(w * w) OVER (PARTITION BY country, id, side)) AS w FROM {source})"


GRAMS = "list_concat(list_transform(range(1, length(skel)), lambda i: substr(skel, CAST(i AS INTEGER), 2)), list_transform(range(1, length(skel) - 1), lambda i: substr(skel, CAST(i AS INTEGER), 3)))"
NAMES = _space("names", GRAMS)
ADDRESSES = _space("addresses", words("naddr"))
JOINT = f"joint_w AS (SELECT country, id, side, 'n:' || feature AS feature, w * {CURRENT.w_name} AS w FROM names UNION ALL SELECT country, id, side, 'a:' || feature, w * {1 - CURRENT.w_name} FROM addresses),\n{_unit('joint_w', 'joint')}"


def retrieval(space: str, cfg: Config = CURRENT) -> str:
    return f"""{space}_common AS (SELECT country, feature FROM {space} JOIN (SELECT country, count(*) AS n FROM prep WHERE source = 'S1' GROUP BY ALL) USING (country) WHERE side = 's' GROUP BY country, feature, n HAVING count(*) > greatest(n * {cfg.knn_max_df}, {cfg.knn_df_floor})),
{space}_left AS (SELECT * FROM {space} ANTI JOIN {space}_common USING (country, feature)),
{_unit(space + "_left", space + "_r")}"""


def nearest(space: str, k: int, least: float, out: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT country, q_id, s1_id, sim, CAST(row_number() OVER (PARTITION BY country, q_id ORDER BY sim DESC, s1_id) AS INTEGER) AS rank FROM (
  SELECT q.country, q.id AS q_id, s.id AS s1_id, round(sum(q.w * s.w), 6) AS sim FROM {space}_r q JOIN {space}_r s USING (country, feature) WHERE q.side = 'q' AND s.side = 's' GROUP BY ALL)
  WHERE sim > {least} QUALIFY row_number() OVER (PARTITION BY country, q_id ORDER BY sim DESC, s1_id) <= {k})"""


def cosine(space: str, pairs: str, out: str) -> str:
    return f"{out} AS (SELECT p.country, p.q_id, p.s1_id, round(sum(q.w * s.w), 6) AS cos FROM {pairs} p JOIN {space} q ON q.side = 'q' AND q.country = p.country AND q.id = p.q_id JOIN {space} s ON s.side = 's' AND s.country = p.country AND s.id = p.s1_id AND s.feature = q.feature GROUP BY ALL)"


def candidates(cfg: Config = CURRENT) -> str:
    flags = ", ".join(f"max(CASE WHEN key_name = '{f}' THEN 1 ELSE 0 END) AS {f}" for f in ("in_knn", "in_knn_name", "in_knn_addr", *cfg.keys))
    return f"""{blocks(cfg)},
{NAMES},
{ADDRESSES},
{JOINT},
{retrieval("joint", cfg)}, {retrieval("names", cfg)}, {retrieval("addresses", cfg)},
{nearest("joint", cfg.knn_k, cfg.knn_min, "knn_all")}, {nearest("names", cfg.knn_k_name, cfg.knn_min_name, "knn_name")}, {nearest("addresses", cfg.knn_k_addr, cfg.knn_min_addr, "knn_addr")},
found AS MATERIALIZED (SELECT country, q_id, s1_id, {flags} FROM (SELECT country, q_id, s1_id, 'in_knn' AS key_name FROM knn_all UNION ALL SELECT country, q_id, s1_id, 'in_knn_name' FROM knn_name
  UNION ALL SELECT country, q_id, s1_id, 'in_knn_addr' FROM knn_addr UNION ALL SELECT * FROM key_pairs) GROUP BY country, q_id, s1_id),
{cosine("joint", "found", "c1")}, {cosine("names", "found", "c2")}, {cosine("addresses", "found", "c3")},
candidates AS MATERIALIZED (SELECT found.*, coalesce(c1.cos, 0) AS cos_all, coalesce(c2.cos, 0) AS cos_name, coalesce(c3.cos, 0) AS cos_addr FROM found
  LEFT JOIN c1 USING (country, q_id, s1_id) LEFT JOIN c2 USING (country, q_id, s1_id) LEFT JOIN c3 USING (country, q_id, s1_id))"""


def margin(key: str, value: str, tie: str) -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY {value} DESC, {tie})"
    return f"CASE WHEN row_number() {over} = 1 THEN {value} - coalesce(lead({value}) {over}, 0) ELSE {value} - first_value({value}) {over} END"


def rank(key: str, value: str, tie: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY {value} DESC, {tie}) AS INTEGER)"


def _eq(c: str) -> str:
    return f"a.{c} <> '' AND a.{c} = b.{c}"


def stage1(cfg: Config = CURRENT) -> str:
    flags = {
        "skel_eq": _eq("skel"), "name_sort_eq": _eq("name_sort"), "name_clean_eq": _eq("nname"), "first_w_eq": _eq("first_w"),
        "pref3_eq": "length(a.nname) >= 3 AND length(b.nname) >= 3 AND substr(a.nname, 1, 3) = substr(b.nname, 1, 3)", "pref5_eq": "length(a.nname) >= 5 AND length(b.nname) >= 5 AND substr(a.nname, 1, 5) = substr(b.nname, 1, 5)",
        "acronym_match": "a.acronym <> '' AND (a.acronym = b.nname OR a.acronym = b.skel) OR b.acronym <> '' AND (b.acronym = a.nname OR b.acronym = a.skel)",
        "hn_both": "a.hn <> '' AND b.hn <> ''", "hn_eq": _eq("hn"), "post_both": "a.postal <> '' AND b.postal <> ''", "post_eq": _eq("postal"), "rn1_eq": _eq("rn1"), "ra1_eq": _eq("ra1"),
        "ra_cross": "a.ra1 <> '' AND (a.ra1 = b.ra2 OR a.ra2 = b.ra1)", "noaddr_a": "a.noaddr", "noaddr_b": "b.noaddr", "nonascii_a": "a.nonascii", "nonascii_b": "b.nonascii", "domain_b": "b.domain", "dba_b": "b.dba",
    }
    own = ", ".join(f"CAST(({v}) AS INTEGER) AS {k}" for k, v in flags.items())
    q = "c.country, c.q_id"
    return f"""{candidates(cfg)},
stage1 AS MATERIALIZED (SELECT c.*, {own}, {rank(q, "cos_all", "c.s1_id")} AS q_rank, count(*) OVER (PARTITION BY {q}) AS q_n, round({margin(q, "cos_all", "c.s1_id")}, 6) AS q_margin,
  round({margin(q, "cos_name", "c.s1_id")}, 6) AS qn_margin, round({margin(q, "cos_addr", "c.s1_id")}, 6) AS qa_margin, round(cos_all / greatest(sum(cos_all) OVER (PARTITION BY {q}), 1e-9), 6) AS q_share
  FROM candidates c JOIN rare a ON a.id = c.s1_id AND a.country = c.country JOIN rare b ON b.id = c.q_id AND b.country = c.country)"""


TRUTH = "truth AS MATERIALIZED (SELECT s.id AS s1_id, q.id AS q_id FROM records s JOIN documents d ON d.doc_id = s.doc_id JOIN documents e ON e.text = d.text AND coalesce(e.lang, '') = coalesce(d.lang, '') JOIN records q ON q.doc_id = e.doc_id WHERE s.source = 'S1' AND q.source <> 'S1')"


def decoded(scored: str, rule, out: str = "matches") -> str:
    return f"""p0 AS (SELECT s1_id, q_id, 1 / (1 + exp(-(logit / {rule.temperature}::DOUBLE + {rule.bias}::DOUBLE))) AS p FROM {scored}),
p1 AS (SELECT * FROM p0 WHERE p >= {rule.floor} QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY p DESC, s1_id) = 1),
p2 AS (SELECT *, row_number() OVER w AS j, sum(p) OVER (PARTITION BY s1_id ORDER BY p DESC, q_id ROWS UNBOUNDED PRECEDING) AS cs, sum(p) OVER (PARTITION BY s1_id) AS tot, max(p) OVER (PARTITION BY s1_id) AS max_p, exp(sum(ln(greatest(1 - p, 1e-12))) OVER (PARTITION BY s1_id)) AS p_empty FROM p1 WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, q_id)),
p3 AS (SELECT *, round(1.25 * cs / (j + 0.25 * (tot + {rule.prior})), 12) AS ef FROM p2),
p4 AS (SELECT *, max(ef) OVER (PARTITION BY s1_id) AS best FROM p3),
p5 AS (SELECT *, min(CASE WHEN ef >= best THEN j END) OVER (PARTITION BY s1_id) AS best_j FROM p4),
{out} AS MATERIALIZED (SELECT s1_id, q_id, p FROM p5 WHERE j <= best_j AND p_empty * {rule.p_empty_mult} < best AND max_p >= {rule.tau_min})"""


def per_entity(pred: str, truth: str = "truth") -> str:
    return f"""pt AS (SELECT s1_id, q_id, max(p) AS p, max(t) AS t FROM (SELECT s1_id, q_id, 1 AS p, 0 AS t FROM {pred} UNION ALL SELECT s1_id, q_id, 0, 1 FROM {truth}) GROUP BY ALL),
pc AS (SELECT s1_id, sum(p) AS n_pred, sum(t) AS n_true, sum(p * t) AS tp FROM pt GROUP BY ALL),
entity AS (SELECT id AS s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM records LEFT JOIN pc ON pc.s1_id = id WHERE source = 'S1'),
scored_entity AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN tp > 0 THEN 1.25::DOUBLE * (tp / n_pred) * (tp / n_true) / (0.25::DOUBLE * (tp / n_pred) + tp / n_true) ELSE 0.0::DOUBLE END AS f05 FROM entity)"""
