"""Reference dimensions of countries, and risk vocabulary. All of it is small and fixed, so it is broadcast or folded into expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. Classes of jurisdictions, by class.
CLASSES = {
    "home": "US",
    "ally": "AL BE BG CA HR CZ DK EE FI FR DE GR HU IS IT LV LT LU ME NL MK NO PL PT RO SK SI ES SE TR GB UK AU NZ JP KR IL BH CO EG JO KW MA PH QA TH TN",
    "partner": "SG AR BR TW IN MX CH AT IE MY AE SA CL CR UY UA GE",
    "neutral": "ID VN ZA PE KZ UZ RS MD AM AZ HK MO KY VG BM PA SC MU LI MT CY JE GG IM BS BZ MH",
    "embargoed": "CU SY VE BY MM AF SD ZW NI",
    "covered": "CN RU KP IR",
}
#: Registries that publish no owners.
OPAQUE = "HK MO KY VG BM PA SC MU LI JE GG IM BS BZ MH AE".split()
#: Armed conflict, by level.
CONFLICT = {
    "high": "UA RU SY YE SD SS MM SO ML BF NE CD PS HT AF LY CF",
    "medium": "IL LB ET NG IQ CM MZ TD CO MX PK IR AM AZ KP TW BD EC VE",
}
#: Natural hazard, by band.
HAZARD = {
    "high": "PH ID IN BD MM JP CN PK VN NP HT MX PG TW CL PE EC GT HN NI MZ MG SO AF IR TR",
    "medium": "LK TH MY KH US IT GR CO CR DO NZ AU DZ MA RO PT ES KR ZA BR AR EG KZ UZ",
    "low": "GB UK IE FR DE NL BE LU AT CH SE NO DK FI PL CZ SK HU SI EE LV LT CA SG IL AE QA KW BH SA JO UY",
}
#: The same of US states.
STATE_HAZARD = {
    "high": "CA TX FL LA OK MS AL PR MO AR NC NY",
    "medium": "WA OR SC GA VA TN KY KS NE IA IL NJ AK HI AZ NM CO NV MN IN OH PA MA",
    "low": "UT ID MT WY ND SD WI MI WV MD DE DC CT RI NH VT ME",
}
#: Severities of classes, and weights of severities and dimensions.
CLASS_SEVERITY = {"home": "clear", "ally": "clear", "partner": "low", "neutral": "low", "embargoed": "high", "covered": "high"}
SEVERITIES = ("clear", "low", "medium", "high")
WEIGHTS = {"designation": 3.0, "proximity": 2.0, "dependency": 2.0, "foreign": 1.5, "financial": 1.5, "regional": 1.0, "media": 0.75}
PERSON_DIMENSIONS = ("designation", "proximity", "foreign", "media")
#: A clear grading counts a third in the mean.
CLEAR_EVIDENCE = 1 / 3
BANDS = ((75, "severe"), (50, "high"), (25, "elevated"), (0, "low"))
SUFFIXES = "incorporated inc corporation corp company co limited ltd llc plc gmbh ag sa nv bv pty llp lp holding holdings group the".split()
HONORIFICS = "mr mrs ms dr sir jr sr ii iii phd mba esq".split()


def flat(levels: dict[str, str]) -> dict[str, str]:
    return {code: level for level, codes in levels.items() for code in codes.split()}


def countries(spark: SparkSession) -> DataFrame:
    """A row for each known country: code, class, opaque, conflict, hazard."""
    cls, conflict, hazard = flat(CLASSES), flat(CONFLICT), flat(HAZARD)
    rows = [(c, cls.get(c), c in OPAQUE, conflict.get(c), hazard.get(c)) for c in sorted({*cls, *conflict, *hazard})]
    return spark.createDataFrame(rows, "country string, class string, opaque boolean, conflict string, hazard string")


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(flat(STATE_HAZARD).items()), "state string, state_hazard string")


def placed(df: DataFrame, code: str = "code") -> DataFrame:
    """df with country, class, opaque, conflict and hazard of its location codes (CN, US-TX); broadcast lookups."""
    spark = df.sparkSession
    c = F.upper(F.trim(F.col(code)))
    at = df.withColumn("country", F.split(c, "-", 2)[0]).withColumn("state", F.when(F.col("country") == "US", F.get(F.split(c, "-", 2), F.lit(1))))
    out = at.join(F.broadcast(countries(spark)), "country", "left").join(F.broadcast(states(spark)), "state", "left")
    return out.withColumn("hazard", F.coalesce("state_hazard", "hazard")).drop("state", "state_hazard")


def rank_of(severity: Column) -> Column:
    """0 to 3, null for no data."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def severity_of(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, s in enumerate(SEVERITIES):
        out = F.when(rank == i, s).otherwise(out)
    return out


def band_of(score: Column) -> Column:
    out = F.lit("low")
    for floor, name in sorted(BANDS):
        out = F.when(score >= floor, name).otherwise(out)
    return F.when(score.isNotNull(), out)
