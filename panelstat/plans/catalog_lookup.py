"""Registered lookup, schema and filter queries (J*, P*, F*, U4, A21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators import estimators as est
from panelstat.operators import lookups as lk
from panelstat.operators import quality as qa
from panelstat.operators import schema as sc
from panelstat.plans import sqlgen as S
from panelstat.plans.catalog_survey import (INDUSTRY_SQL, OCCUPATION_SQL, STATUS_SQL, industry_codebook,
                                            occupation_codebook)
from panelstat.plans.registry import ORACLE, r6, register, sql_r6
from panelstat.plans.views import (HOUSEHOLD_RAW_SQL, PERSON_RAW_SQL, household_raw, households, person_raw,
                                   persons, table, with_views)
from panelstat.session import shared_path
from panelstat.sources import codebooks as cb, sinks
from panelstat.sources.sinks import stored
from panelstat.sources.readers import REGION_LINE_RE, last_per_key, region_codes_from_text


def district_codebook(spark, sf_dir):
    """(STATE, code, name): twenty districts per state, derived from nation as
    sheet-like rows (mixed case, padded, unpadded codes) and built by rule."""
    n = table(spark, sf_dir, "nation")
    ex = n.select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("state_name"), "n_nationkey",
                  F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i"))
    sheet = ex.select("state_name", F.col("i").cast("string").alias("district_code"),
                      F.concat(F.lit("district "), F.col("n_nationkey").cast("string"), F.lit("-"),
                               F.lpad(F.col("i").cast("string"), 2, "0")).alias("district_name"),
                      (F.col("n_nationkey") * 100 + F.col("i")).alias("row_no"))
    return lk.build_district_codebook(sheet, "state_name", "district_code", "district_name", "row_no")


DISTRICT_SQL = ("(SELECT upper(n_name) AS state, lpad(CAST(i AS VARCHAR), 2, '0') AS code, "
                "'district ' || CAST(n_nationkey AS VARCHAR) || '-' || lpad(CAST(i AS VARCHAR), 2, '0') AS label "
                "FROM nation, range(1, 21) AS t(i))")


def region_codebook(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select(F.lpad(F.col("r_regionkey").cast("string"), 2, "0").alias("code"), F.col("r_name").alias("label"))


REGION_SQL = "(SELECT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS code, r_name AS label FROM region)"


def _zfill_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) >= {n} THEN {c} ELSE lpad({c}, {n}, '0') END"


# --------------------------------------------------------------------------- J1 - J8

@register("lookup_district", f"""
SELECT h.state, coalesce(d.label, 'UNKNOWN_DISTRICT') AS district, count(*) AS n
FROM ({HOUSEHOLD_RAW_SQL}) h LEFT JOIN {DISTRICT_SQL} d
  ON d.state = upper(h.state) AND d.code = {_zfill_sql('h.district_code', 2)}
GROUP BY h.state, district""")
def q_lookup_district(spark, sf_dir):
    hh = lk.decode_district(household_raw(spark, sf_dir), district_codebook(spark, sf_dir))
    return hh.groupBy("state", "district").agg(F.count(F.lit(1)).alias("n"))


@register("lookup_region", f"""
SELECT h.region_code, r.label AS region, count(*) AS n
FROM ({HOUSEHOLD_RAW_SQL}) h LEFT JOIN {REGION_SQL} r ON r.code = {_zfill_sql('h.region_code', 2)}
GROUP BY h.region_code, region""")
def q_lookup_region(spark, sf_dir):
    hh = lk.decode_region(household_raw(spark, sf_dir), region_codebook(spark, sf_dir))
    return hh.groupBy("region_code", "region").agg(F.count(F.lit(1)).alias("n"))


@register("lookup_household_type", f"""
SELECT h.sector, h.hh_type_code, coalesce(ht.label, 'others') AS household_type, count(*) AS n
FROM ({HOUSEHOLD_RAW_SQL}) h LEFT JOIN {S.values_table(cb.HOUSEHOLD_TYPE, ['sector', 'code', 'label'], 'ht')}
  ON ht.sector = h.sector AND ht.code = h.hh_type_code
GROUP BY h.sector, h.hh_type_code, household_type""")
def q_lookup_household_type(spark, sf_dir):
    hh = lk.decode_household_type(household_raw(spark, sf_dir), cb.household_type_codebook(spark))
    return hh.groupBy("sector", "hh_type_code", "household_type").agg(F.count(F.lit(1)).alias("n"))


@register("lookup_prefix", f"""
SELECT substr(p.industry_code, 1, 2) AS prefix, i.label AS industry, count(*) AS n
FROM ({PERSON_RAW_SQL}) p LEFT JOIN {INDUSTRY_SQL} i ON i.code = {_zfill_sql('substr(p.industry_code, 1, 2)', 2)}
GROUP BY prefix, industry""")
def q_lookup_prefix(spark, sf_dir):
    p = lk.decode_prefix(person_raw(spark, sf_dir), industry_codebook(spark), "industry_code", "industry", 2)
    return p.groupBy(F.substring("industry_code", 1, 2).alias("prefix"), "industry").agg(F.count(F.lit(1)).alias("n"))


@register("lookup_occupation", f"""
SELECT p.occupation_code, o.label AS occupation, count(*) AS n
FROM ({PERSON_RAW_SQL}) p LEFT JOIN {OCCUPATION_SQL} o ON o.code = p.occupation_code
GROUP BY p.occupation_code, occupation""")
def q_lookup_occupation(spark, sf_dir):
    p = lk.decode_full(person_raw(spark, sf_dir), occupation_codebook(spark), "occupation_code", "occupation")
    return p.groupBy("occupation_code", "occupation").agg(F.count(F.lit(1)).alias("n"))


def _enum_sql(c: str, pairs) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {c} {arms} ELSE {c} END"


@register("enum_passthrough", f"""
SELECT {_enum_sql('quarter', cb.QUARTER)} AS quarter, {_enum_sql('visit', cb.VISIT)} AS visit, count(*) AS n
FROM ({HOUSEHOLD_RAW_SQL}) h GROUP BY 1, 2""")
def q_enum_passthrough(spark, sf_dir):
    hh = household_raw(spark, sf_dir)
    hh = hh.withColumns({"quarter": lk.enum_passthrough("quarter", cb.QUARTER),
                         "visit": lk.enum_passthrough("visit", cb.VISIT)})
    return hh.groupBy("quarter", "visit").agg(F.count(F.lit(1)).alias("n"))


_STATUS_OR_NEW = "CASE WHEN p.person_no = 5 THEN '99' ELSE p.status_code END"


@register("status_category", f"""
SELECT {_STATUS_OR_NEW} AS status_code, coalesce(sc.category, 'unknown') AS status_category, count(*) AS n
FROM ({PERSON_RAW_SQL}) p LEFT JOIN {STATUS_SQL} ON sc.code = {_STATUS_OR_NEW}
GROUP BY 1, 2""")
def q_status_category(spark, sf_dir):
    """One person in each household has a code that the codebook lacks."""
    p = person_raw(spark, sf_dir)
    p = p.withColumn("status_code", F.when(F.col("person_no") == 5, F.lit("99")).otherwise(F.col("status_code")))
    p = lk.status_category(p, cb.status_codebook(spark))
    return p.groupBy("status_code", "status_category").agg(F.count(F.lit(1)).alias("n"))


@register("value_labels", f"""
SELECT {_enum_sql('quarter', cb.QUARTER)} AS quarter, {_enum_sql('visit', cb.VISIT)} AS visit,
  {_enum_sql('social_group', [('others', 'general')])} AS social_group, count(*) AS n
FROM ({HOUSEHOLD_RAW_SQL}) h GROUP BY 1, 2, 3""")
def q_value_labels(spark, sf_dir):
    rows = ([("quarter", k, v) for k, v in cb.QUARTER] + [("visit", k, v) for k, v in cb.VISIT]
            + [("social_group", "others", "general")])
    labels = cb.literal_table(spark, rows, ["column", "code", "label"])
    hh = lk.apply_value_labels(household_raw(spark, sf_dir), labels, ["quarter", "visit", "social_group"])
    return hh.groupBy("quarter", "visit", "social_group").agg(F.count(F.lit(1)).alias("n"))


_MANY = 60


@register("value_labels_many", f"""
SELECT c_custkey, {", ".join(f"CASE WHEN (c_custkey + {i}) % 10 < 7 THEN 'label {i}/' || CAST((c_custkey + {i}) % 10 AS VARCHAR) ELSE CAST((c_custkey + {i}) % 10 AS VARCHAR) END AS v{i}" for i in range(_MANY))}
FROM customer""")
def q_value_labels_many(spark, sf_dir):
    """J8 over 60 columns, three codes of each without a label."""
    k = F.col("c_custkey")
    coded = table(spark, sf_dir, "customer").select(k, *[((k + i) % 10).alias(f"v{i}") for i in range(_MANY)])
    labels = cb.literal_table(spark, [(f"v{i}", str(c), f"label {i}/{c}") for i in range(_MANY) for c in range(7)],
                              ["column", "code", "label"])
    return lk.apply_value_labels(coded, labels, [f"v{i}" for i in range(_MANY)])


_PANELS = {"v1_urban": ("State/Ut Code", "Balance"), "rv_urban": ("state", "balance"), "v1_rural": ("STATE", "bal"), "rv_rural": ("state", None)}


@register("panels_one_scan", """
SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS state, CASE WHEN c_custkey % 4 < 3 THEN round(c_acctbal, 2) END AS balance,
  CASE c_custkey % 4 WHEN 0 THEN 'v1_urban' WHEN 1 THEN 'rv_urban' WHEN 2 THEN 'v1_rural' ELSE 'rv_rural' END AS panel FROM customer""")
def q_panels_one_scan(spark, sf_dir):
    """Panels of four layouts through one scan."""
    c, paths = table(spark, sf_dir, "customer"), {}
    for n, (panel, (state, balance)) in enumerate(_PANELS.items()):
        paths[panel] = shared_path(spark, f"panel-{panel}")
        cols = [F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias(state)]
        cols += [F.round("c_acctbal", 2).alias(balance)] if balance else []
        sinks.write_records(c.where(F.col("c_custkey") % 4 == n).select(*cols), paths[panel])
    aliases = {"id": {}, "state": {p: s for p, (s, _) in _PANELS.items()}, "balance": {p: b for p, (_, b) in _PANELS.items()}}
    return sc.read_panels(spark, paths, aliases, {"id": "long", "balance": "double"})


@register("unmatched_codes", f"""
SELECT substr(p.industry_code, 1, 2) AS code, count(*) AS n FROM ({PERSON_RAW_SQL}) p
WHERE substr(p.industry_code, 1, 2) NOT IN (SELECT code FROM {INDUSTRY_SQL} i)
GROUP BY code""")
def q_unmatched_codes(spark, sf_dir):
    return lk.unmatched_codes(person_raw(spark, sf_dir), industry_codebook(spark),
                              F.substring("industry_code", 1, 2))


@register("literacy_by_religion", with_views(sql_r6("""
SELECT h.religion, 1.0 - sum(CASE WHEN coalesce(p.general_education = 'not literate', FALSE) THEN p.weight ELSE 0.0 END)
  / nullif(sum(p.weight), 0) AS literacy_rate
FROM person_v p JOIN household_v h ON p.hh_id = h.hh_id
WHERE h.religion IS NOT NULL GROUP BY h.religion""", ["literacy_rate"])))
def q_literacy_by_religion(spark, sf_dir):
    p = persons(spark, sf_dir)
    h = households(spark, sf_dir).select("hh_id", "religion")
    joined = p.join(h, "hh_id")
    share = est.indicator_share(joined, ["religion"], F.col("general_education") == "not literate", "weight",
                                name="_nl")
    return r6(share.select("religion", (F.lit(1.0) - F.col("_nl")).alias("literacy_rate")))


@register("literacy_by_religion_stored", ORACLE["literacy_by_religion"])
def q_literacy_by_religion_stored(spark, sf_dir):
    """J13 on stored tables: both sides bucketed by household, joined without an exchange."""
    p = stored(spark, persons(spark, sf_dir).select("hh_id", "general_education", "weight"), "hh_id", "persons")
    h = stored(spark, households(spark, sf_dir).select("hh_id", "religion"), "hh_id", "households")
    share = est.indicator_share(p.join(h.hint("merge"), "hh_id"), ["religion"], F.col("general_education") == "not literate",
                                "weight", name="_nl")
    return r6(share.select("religion", (F.lit(1.0) - F.col("_nl")).alias("literacy_rate")))


# --------------------------------------------------------------------------- P1 - P9

@register("rename", f"""
SELECT hh_id, state AS state_ut, household_size AS area FROM ({HOUSEHOLD_RAW_SQL}) h""")
def q_rename(spark, sf_dir):
    hh = household_raw(spark, sf_dir).select("hh_id", "state", "sector", "household_size")
    # 'sector' and 'household_size' both map to 'area': the later column wins
    return sc.rename_columns(hh, {"state": "state_ut", "sector": "area", "household_size": "area"})


@register("select_present", f"""
SELECT hh_id, religion, state FROM ({HOUSEHOLD_RAW_SQL}) h""")
def q_select_present(spark, sf_dir):
    return sc.select_present(household_raw(spark, sf_dir), ["hh_id", "religion", "no_such_column", "state"])


@register("align", f"""
SELECT panel, count(earning) AS n_earning, count(training) AS n_training, round(sum(earning), 6) AS sum_earning
FROM (SELECT panel, coalesce(_price_if_regular, NULL) AS earning, CAST(NULL AS VARCHAR) AS training FROM
      (SELECT *, CASE WHEN status_code = '31' THEN _price END AS _price_if_regular FROM ({PERSON_RAW_SQL}) p0) p) t
GROUP BY panel""")
def q_align(spark, sf_dir):
    p = persons(spark, sf_dir)
    # first-visit files spell the earning column one way, revisits another
    fv = p.where(F.col("panel") == "first_visit").select("panel", F.col("regular_earning"))
    rv = p.where(F.col("panel") == "revisit").select("panel", F.col("regular_earning").alias("salarid_earning"))
    stacked = fv.unionByName(rv, allowMissingColumns=True)
    aligned = sc.align_schema(stacked, {"earning": ["regular_earning", "salarid_earning"],
                                        "training": ["vocational_training"]},
                              types={"earning": "double", "training": "string"})
    return r6(aligned.groupBy("panel").agg(F.count("earning").alias("n_earning"), F.count("training").alias("n_training"),
                                           F.sum("earning").alias("sum_earning")))


@register("blank_to_null", f"""
SELECT count(*) AS n, count(nullif(district_code, '')) AS n_district FROM ({PERSON_RAW_SQL}) p""")
def q_blank_to_null(spark, sf_dir):
    p = sc.blank_to_null(person_raw(spark, sf_dir).select("district_code", "state"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count("district_code").alias("n_district"))


_STATUS_CAT_PAIRS = [(c, cat) for c, _, cat in cb.STATUS]


def _day_sql(i: int) -> str:
    from panelstat.plans.views import STATUS_CODES, _sql_case_mod
    code = _sql_case_mod(f"l_partkey + {i}", STATUS_CODES)
    return f"count_if(coalesce({_enum_sql(code, _STATUS_CAT_PAIRS)}, '') = 'employed') AS status_day{i}"


@register("matching_cols", "SELECT " + ", ".join(_day_sql(i) for i in range(1, 8)) + " FROM lineitem")
def q_matching_cols(spark, sf_dir):
    from panelstat.plans.views import STATUS_CODES, _case_mod
    li = table(spark, sf_dir, "lineitem")
    wide = li.select(*[_case_mod(F.col("l_partkey") + i, STATUS_CODES).alias(f"status_day{i}") for i in range(1, 8)])
    decoded = sc.transform_matching(wide, "status_day", lambda c: lk.enum_passthrough(c, _STATUS_CAT_PAIRS))
    return decoded.agg(*[F.count_if(F.coalesce(F.col(c), F.lit("")) == "employed").alias(c) for c in decoded.columns])


# --------------------------------------------------------------------------- F3 - F6, U4, A21

@register("quarantine", f"""
SELECT (age IS NULL OR vocational_training IS NULL) AS quarantined, count(*) AS n
FROM ({PERSON_RAW_SQL}) p GROUP BY quarantined""")
def q_quarantine(spark, sf_dir):
    p = qa.with_quarantine_flag(person_raw(spark, sf_dir), ["age", "vocational_training"])
    return p.groupBy("quarantined").agg(F.count(F.lit(1)).alias("n"))


@register("url_filter", """
SELECT page_id, url FROM pages WHERE page_id % 4 NOT IN (0, 1)""")
def q_url_filter(spark, sf_dir):
    """Half of the addresses are made unusable: one without a scheme, one null."""
    page = F.col("page_id")
    url = F.when(page % 4 == 0, F.regexp_replace("url", "^https?://", "")).when(page % 4 != 1, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url")).where(qa.url_ok("url"))


@register("prefix_filter", """
SELECT lang, count(*) AS n FROM documents WHERE starts_with(lower(text), 'the') GROUP BY lang""")
def q_prefix_filter(spark, sf_dir):
    return qa.prefix_filter(table(spark, sf_dir, "documents"), "text", "the").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"))


@register("dedupe_last", """
SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id""")
def q_dedupe_last(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return last_per_key(ev, "user_id", "event_type", F.struct("ts", "event_id"))


@register("file_counts", """
SELECT CASE WHEN grouping(listing) = 1 THEN 'all' ELSE CAST(listing AS VARCHAR) END AS listing,
  count_if(ok) AS succeeded, count_if(NOT ok) AS failed
FROM (SELECT page_id % 10 AS listing, starts_with(url, 'http') AND contains(html, '</html>') AS ok FROM pages) t
GROUP BY ROLLUP (listing)""")
def q_file_counts(spark, sf_dir):
    pg = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("listing"),
                                               (qa.url_ok("url") & F.col("html").contains("</html>")).alias("ok"))
    out = pg.rollup("listing").agg(F.grouping("listing").alias("_g"), F.count_if("ok").alias("succeeded"),
                                   F.count_if(~F.col("ok")).alias("failed"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("listing").cast("string")).alias("listing"),
                      "succeeded", "failed")


def region_listing(spark, sf_dir):
    """One listing line per nation: 3-digit code (codes repeat every 20
    nations), a letters-only name and the region number in parentheses."""
    n = table(spark, sf_dir, "nation")
    code = F.lpad(((F.col("n_nationkey") % 20) * 37 % 900 + 100).cast("string"), 3, "0")
    name = F.translate(F.col("n_name"), "0123456789_", "ABCDEFGHIJ ")
    line = F.concat(code, F.lit(" "), name, F.lit(" Region ("), F.col("n_regionkey").cast("string"), F.lit(")"))
    return n.select("n_nationkey", line.alias("text"))


_LISTING_SQL = ("(SELECT n_nationkey, lpad(CAST((n_nationkey % 20) * 37 % 900 + 100 AS VARCHAR), 3, '0') || ' ' || "
                "translate(n_name, '0123456789_', 'ABCDEFGHIJ ') || ' Region (' || CAST(n_regionkey AS VARCHAR) || ')' "
                "AS text FROM nation)")
_REGION_RE_SQL = REGION_LINE_RE.replace("(?=", "(?:")


@register("region_codes", f"""
SELECT code, arg_max(trim(name), struct_pack(o := n_nationkey, p := pos)) AS name FROM (
  SELECT n_nationkey, unnest(regexp_extract_all(text, '{_REGION_RE_SQL}', 1)) AS code,
         unnest(regexp_extract_all(text, '{_REGION_RE_SQL}', 2)) AS name,
         unnest(range(len(regexp_extract_all(text, '{_REGION_RE_SQL}', 1)))) AS pos
  FROM {_LISTING_SQL} l) t GROUP BY code""")
def q_region_codes(spark, sf_dir):
    return region_codes_from_text(region_listing(spark, sf_dir), "text", "n_nationkey")


# --------------------------------------------------------------------------- P5, P8, P10, P12, P13

@register("constant_column", """
SELECT l_orderkey AS hh_id, l_linenumber AS person_no, 'Revisit Person level 7' AS file_identification
FROM lineitem""")
def q_constant_column(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hh_id"), F.col("l_linenumber").alias("person_no"))
    return sc.with_constant(li, "file_identification", "Revisit Person level 7")


@register("normalise_headers", """
SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_NAME", n_regionkey AS "N_REGIONKEY" FROM nation""")
def q_normalise_headers(spark, sf_dir):
    return sc.normalise_headers(table(spark, sf_dir, "nation"))


@register("positional_columns", """
SELECT c_name, c_nationkey FROM customer""")
def q_positional_columns(spark, sf_dir):
    return sc.positional(table(spark, sf_dir, "customer"), 1, 3)


@register("source_file", """
SELECT 'orders.parquet' AS file, count(*) AS n FROM orders""")
def q_source_file(spark, sf_dir):
    o = sc.with_source_file(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return o.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@register("union_panels", with_views("""
SELECT panel, sector, count(*) AS n, count(regular_earning) AS n_earning FROM person_v GROUP BY panel, sector"""))
def q_union_panels(spark, sf_dir):
    p = persons(spark, sf_dir)
    frames = {name: p.where(F.col("panel") == name).drop("panel") for name in ("first_visit", "revisit")}
    u = sc.union_panels(frames)
    return u.groupBy("panel", "sector").agg(F.count(F.lit(1)).alias("n"), F.count("regular_earning").alias("n_earning"))
