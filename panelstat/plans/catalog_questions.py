"""The question surface (I1-I20) as a catalogue: 110 questions, one job.

The wording of the published questions is not needed to compute them; each is
kept as its indicator, scope and form, with states of the test data in place of the
published ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators.lookups import status_category
from panelstat.operators.questions import Indicator, Operand, Question, answers, lattice, specifications
from panelstat.plans.catalog_indicators import GRADUATE, NOT_LITERATE
from panelstat.plans.catalog_survey import PERSON_STATUS_SQL
from panelstat.plans.registry import r6, register
from panelstat.plans.views import households, persons, with_views
from panelstat.sources.codebooks import CASUAL_CODES, REGULAR_CODES, SELF_EMPLOYED_CODES, status_codebook

DIMS = ["state", "sector", "gender", "religion", "industry"]
# The first and last two-digit division of industry sections (NIC 2008).
SECTIONS = [("agriculture", 1, 3), ("mining", 5, 9), ("manufacturing", 10, 33), ("construction", 41, 43), ("trade", 45, 47)]
# Activity status groups by code.
STATUS_GROUPS = {"self": SELF_EMPLOYED_CODES, "regular": REGULAR_CODES, "casual": CASUAL_CODES}
YOUTH = (15, 29)


def _codes(codes) -> str:
    return ", ".join(f"'{c}'" for c in codes)


_SECTION = "CASE " + " ".join(f"WHEN try_cast(substr(industry_code, 1, 2) AS INT) BETWEEN {a} AND {b} THEN '{s}'"
                              for s, a, b in SECTIONS) + " ELSE 'other' END"
_EMPLOYED, _IDLE = "status_category = 'employed'", "status_category = 'unemployed'"
_YOUTH = f"age BETWEEN {YOUTH[0]} AND {YOUTH[1]}"
# Summed columns: the condition under which a person's weight counts, and the factor.
PERSON_SUMS = {
    "people": ("TRUE", "1.0"), "employed": (_EMPLOYED, "1.0"), "idle": (_IDLE, "1.0"),
    "force": (f"{_EMPLOYED} OR {_IDLE}", "1.0"), "idle_youth": (f"{_IDLE} AND {_YOUTH}", "1.0"),
    "force_youth": (f"({_EMPLOYED} OR {_IDLE}) AND {_YOUTH}", "1.0"),
    "literate": (f"coalesce(general_education <> '{NOT_LITERATE}', TRUE)", "1.0"),
    "graduate": (f"general_education = '{GRADUATE}'", "1.0"), "secondary": ("general_education = 'secondary'", "1.0"),
    "trained": ("vocational_training LIKE 'received formal%'", "1.0"),
    **{f"{g}_workers": (f"{_EMPLOYED} AND status_code IN ({_codes(c)})", "1.0") for g, c in STATUS_GROUPS.items()},
    **{f"{n}_{kind}": (f"{c} IS NOT NULL", v) for n, c in (("wage", "regular_earning"), ("earning", "self_employed_earning"),
                                                        ("daily", "casual_wage")) for kind, v in (("sum", c), ("weight", "1.0"))},
}
PERSON_INDICATORS = {
    "regular_wage": Indicator("wage_sum", "wage_weight", 1.0), "self_earning": Indicator("earning_sum", "earning_weight", 1.0),
    "casual_wage": Indicator("daily_sum", "daily_weight", 1.0), "people": Indicator("people"), "employed": Indicator("employed"),
    **{f"{g}_share": Indicator(f"{g}_workers", "employed") for g in STATUS_GROUPS},
    "literacy": Indicator("literate", "people"), "graduates": Indicator("graduate", "people"),
    "secondary": Indicator("secondary", "people"), "trained": Indicator("trained", "people"),
    "unemployment": Indicator("idle", "force"), "youth_unemployment": Indicator("idle_youth", "force_youth"),
    "wpr": Indicator("employed", "people"),
}
HOUSEHOLD_SUMS = {"houses": ("household_size IS NOT NULL", "1.0"), "sizes": ("household_size IS NOT NULL", "household_size"),
                  "spent": ("expenditure IS NOT NULL", "expenditure")}
HOUSEHOLD_INDICATORS = {"household_size": Indicator("sizes", "houses", 1.0), "expenditure": Indicator("spent")}


def _catalogue() -> list[Question]:
    out: list[Question] = []

    def ask(group: str, form: str, *operands: Operand, **how) -> None:
        out.append(Question(f"{group}-{sum(q.id.startswith(group + '-') for q in out) + 1}", form, operands, **how))

    def scope(text: str) -> dict:
        """Scopes like 'rural male NATION_0', by the words' kinds."""
        got = {}
        for word in text.split():
            kind = ("sector" if word in ("rural", "urban") else "gender" if word in ("male", "female") else
                    "industry" if word in [s for s, _, _ in SECTIONS] else "state" if word.isupper() else "religion")
            got[kind] = word
        return got

    def values(group: str, indicator: str, scopes: str, digits: int = 1) -> None:
        for s in scopes.split(","):
            ask(group, "value", Operand(indicator, scope(s)), digits=digits)

    def ends(group: str, indicator: str, *wanted: tuple[str, str], over: str = "state", k: int = 1) -> None:
        for form, s in wanted:
            ask(group, form, Operand(indicator, scope(s)), over=over, k=k)

    values("I1", "regular_wage", "rural male NATION_0,rural male NATION_1,urban female NATION_2,NATION_3,male NATION_4,female NATION_4,male NATION_5,", 0)
    values("I2", "self_earning", "rural female NATION_2,male NATION_4,female NATION_6,NATION_7,NATION_8,urban male NATION_8,urban male NATION_5,"
                                 "urban female NATION_5,rural male NATION_5,rural female NATION_5", 0)
    values("I3", "casual_wage", "rural male,rural female,rural,urban,urban female,female,male,", 2)
    for indicator in ("regular_wage", "casual_wage"):
        ask("I4", "top", Operand(indicator, {"gender": "male"}), Operand(indicator, {"gender": "female"}), over="state")
    for kind, scopes in (("self", "rural female NATION_4,urban male NATION_4,NATION_2,NATION_0,NATION_9,male NATION_4,rural female NATION_2,urban male NATION_10,"
                                  "male NATION_11,urban female NATION_12"),
                         ("regular", "female,rural female NATION_4,urban male NATION_10,NATION_9,NATION_3,NATION_10,male NATION_13,urban female NATION_10,"
                                     "female NATION_11,urban male NATION_0,urban male NATION_12"), ("casual", "NATION_13,NATION_14,rural female NATION_2")):
        values("I5", f"{kind}_share", scopes)
    ends("I6", "self_share", ("top", ""), ("bottom", ""))
    ends("I6", "casual_share", ("top", ""), ("bottom", ""))
    ends("I6", "regular_share", ("top", "urban male"), ("bottom", "urban female"))
    for kind, scopes in (("casual", "construction,rural male construction,rural female construction"),
                         ("self", "agriculture,rural male agriculture,rural female trade"),
                         ("regular", "rural male manufacturing,mining,agriculture")):
        values("I7", f"{kind}_share", scopes)
    ends("I8", "casual_share", ("top", "rural male"), over="industry")
    ask("I8", "yes_no", *(Operand("regular_share", scope(f"{s} female manufacturing")) for s in ("urban", "rural")))
    ask("I8", "larger", *(Operand("self_share", scope(f"urban {g} manufacturing"), g) for g in ("male", "female")))
    for s in ("male NATION_4", "rural male NATION_10", "urban male NATION_3"):
        ask("I9", "ratio", Operand("employed", scope(s + " agriculture")), Operand("employed", scope(s)), scale=100.0)
    values("I10", "literacy", "urban,rural,,urban male,urban female")
    values("I11", "literacy", "rural male building,urban machinery,urban female building,female furniture")
    values("I12", "unemployment", "female NATION_8,urban male NATION_4,rural male NATION_1")
    ends("I13", "unemployment", ("top", ""), ("bottom", ""))
    values("I14", "wpr", "urban female NATION_3,female,male,rural male NATION_15,NATION_10")
    ends("I15", "wpr", ("top", ""), ("bottom", ""))
    ask("I16", "top", Operand("people", scope("rural female")), Operand("people", scope("rural male")), over="state", scale=1000.0)
    values("I17", "household_size", "NATION_0", 2)
    values("I17", "expenditure", "NATION_0", 0)
    ends("I17", "expenditure", ("top", ""), k=5)
    ends("I18", "literacy", ("top", ""), over="religion")
    values("I18", "literacy", "NATION_0")
    ask("I18", "gap", Operand("literacy", scope("male NATION_0")), Operand("literacy", scope("female NATION_0")))
    ends("I19", "graduates", ("top", ""))
    values("I19", "secondary", "NATION_0")
    ends("I19", "trained", ("top", ""), k=3)
    values("I20", "wpr", "male urban NATION_0")
    ends("I20", "youth_unemployment", ("top", ""))
    ask("I20", "top", Operand("employed", scope("agriculture")), Operand("employed"), over="state", k=5, scale=100.0)
    values("I20", "regular_share", "NATION_0")
    ends("I20", "self_share", ("top", "female"))
    ends("I20", "employed", ("top", "NATION_0"), over="industry", k=3)
    return out


QUESTIONS = _catalogue()


def _person_rows(spark, sf_dir):
    people = status_category(persons(spark, sf_dir), status_codebook(spark))
    homes = households(spark, sf_dir).select("hh_id", "religion")
    return people.join(homes, "hh_id", "left").withColumn("industry", F.expr(_SECTION))


def _household_rows(spark, sf_dir):
    blank = F.lit(None).cast("string")
    return households(spark, sf_dir).withColumns({"gender": blank, "industry": blank})


def _sums(sums: dict[str, tuple[str, str]]) -> dict:
    return {n: F.expr(f"CASE WHEN {c} THEN weight * {v} ELSE 0.0D END") for n, (c, v) in sums.items()}


# --------------------------------------------------------------------------- the same answers, a statement of its own for each

def _operand_sql(o: Operand, over: str | None) -> str:
    person = o.indicator in PERSON_INDICATORS
    i = (PERSON_INDICATORS if person else HOUSEHOLD_INDICATORS)[o.indicator]
    sums = PERSON_SUMS if person else HOUSEHOLD_SUMS

    def total(name: str) -> str:
        cond, factor = sums[name]
        return f"sum(CASE WHEN {cond} THEN weight * {factor} ELSE 0.0 END)"
    value = total(i.part) if i.whole is None else f"{i.scale} * {total(i.part)} / nullif({total(i.whole)}, 0)"
    where = " AND ".join([f"{d} = '{v}'" for d, v in o.scope.items()] + ([f"{over} IS NOT NULL"] if over else [])) or "TRUE"
    table = "people_q" if person else "household_v"
    return (f"SELECT {over} AS key, {value} AS v FROM {table} WHERE {where} GROUP BY {over}" if over
            else f"SELECT NULL::VARCHAR AS key, {value} AS v FROM {table} WHERE {where}")


def _question_sql(q: Question) -> str:
    a = _operand_sql(q.operands[0], q.over)
    if len(q.operands) == 1:
        source = f"SELECT key, v FROM ({a}) a"
    else:
        value = f"{q.scale} * a.v / nullif(b.v, 0)" if q.form == "ratio" or q.scale != 1.0 else "a.v - b.v"
        source = (f"SELECT a.key, {value} AS v FROM ({a}) a JOIN ({_operand_sql(q.operands[1], q.over)}) b "
                  "ON a.key IS NOT DISTINCT FROM b.key")
    shown = f"format('{{:,.{q.digits}f}}', v)"
    if q.form == "yes_no":
        shown = "CASE WHEN v > 0 THEN 'Yes' ELSE 'No' END"
    elif q.form == "larger":
        shown = f"CASE WHEN v > 0 THEN '{q.operands[0].label}' WHEN v < 0 THEN '{q.operands[1].label}' ELSE 'equal' END"
    elif q.over:
        shown = "key"
    order = "v" if q.form == "bottom" else "-v"
    return (f"SELECT '{q.id}' AS question_id, string_agg(answer, ', ' ORDER BY n) AS answer, round(first(v ORDER BY n), 6) AS value FROM ("
            f"SELECT CASE WHEN v IS NOT NULL THEN {shown} END AS answer, v, row_number() OVER (ORDER BY {order} NULLS LAST, key) AS n "
            f"FROM (SELECT key, round(v, 9) AS v FROM ({source}) s) r) t WHERE n <= {q.k}")


ORACLE = with_views(f""", people_q AS MATERIALIZED (
  SELECT ps.*, h.religion, {_SECTION} AS industry FROM {PERSON_STATUS_SQL} ps LEFT JOIN household_v h ON ps.hh_id = h.hh_id)
""" + "\nUNION ALL\n".join(map(_question_sql, QUESTIONS)))


@register("answer_questions", ORACLE)
def q_answer_questions(spark, sf_dir):
    """All 110 questions: (question_id, answer, value)."""
    cells = [lattice(_person_rows(spark, sf_dir), DIMS, _sums(PERSON_SUMS), PERSON_INDICATORS, QUESTIONS),
             lattice(_household_rows(spark, sf_dir), DIMS, _sums(HOUSEHOLD_SUMS), HOUSEHOLD_INDICATORS, QUESTIONS)]
    specs = specifications(spark, QUESTIONS, DIMS)
    return r6(answers(specs, cells[0].unionByName(cells[1]), DIMS))
