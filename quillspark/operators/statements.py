"""Brokerage statements: XML to elements, and elements to net asset value, cash, positions and summaries."""

import xml.etree.ElementTree as ET
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

ELEMENTS = "statement_id long, elem_seq int, tag string, attrs map<string,string>, error string"
#: Names that the reports use.
DATES = ("reportDate", "fromDate", "toDate", "date")
NAV_TAGS = ("ChangeInNAV", "NetAssetValue", "NetAssetValueInBase", "EquitySummaryByReportDateInBase")
NAV_FIELDS = ("endingValue", "netLiquidation", "netLiquidationValue", "total")
POSITION = ("symbol", "description", "assetCategory", "currency", "position", "markPrice", "positionValue", "fxRateToBase", "percentOfNAV")
PRIVATE = "account|acctid|clientid"
TRANSIENT = {"statement": ("1001", "1018", "1019", "1020", "1021"), "http": ("429", "500", "502", "503", "504"), "audio": ("408", "429", "500", "502", "503", "504")}


def _walk(batches, at_once: int = 2_000):
    """Batches of elements, ``at_once`` rows at most in each: a batch of reports has many times its rows in elements, which are never all held."""
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())

    def elements(key, xml):
        try:
            if xml is None or "<!DOCTYPE" in xml:
                raise ET.ParseError("no report")
            root = ET.fromstring(xml)
        except ET.ParseError:
            yield key, None, None, None, "not XML"
            return
        for i, e in enumerate(root.iter()):
            yield key, i, e.tag, list(e.attrib.items()), None

    for batch in batches:
        # One report at a time becomes a string.
        rows = chain.from_iterable(elements(key.as_py(), xml.as_py()) for key, xml in zip(batch.column(0), batch.column(1)))
        while held := list(islice(rows, at_once)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["statement_id", "elem_seq", "tag", "attrs", "error"])


def statement_elements(statements: DataFrame) -> DataFrame:
    """A row for each element in document order, with its attributes; a report that is no XML is one row with an error. Document types are refused, so no entity is expanded."""
    ship(statements.sparkSession)
    return statements.select("statement_id", "xml").mapInArrow(_walk, ELEMENTS)


def attr(name: str) -> Column:
    """An attribute that is not empty; "0" is kept."""
    return F.nullif(F.col("attrs")[name], F.lit(""))


def positions(elements: DataFrame) -> DataFrame:
    return elements.where("tag = 'OpenPosition'").select("statement_id", "elem_seq", *(attr(a).alias(a) for a in POSITION))


def cash(elements: DataFrame) -> DataFrame:
    rows = elements.where("tag = 'CashReportCurrency'").where(attr("endingCash").isNotNull())
    return rows.select("statement_id", "elem_seq", F.coalesce(F.col("attrs")["currency"], F.lit("unknown")).alias("currency"), attr("endingCash").alias("ending_cash"), F.coalesce(attr("endingCash").try_cast("decimal(38,10)") < 0, F.lit(False)).alias("is_debit"))


def redact(elements: DataFrame) -> DataFrame:
    return elements.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~F.lower(k).rlike(PRIVATE)))


def nav_candidates(elements: DataFrame) -> DataFrame:
    """First of each (section, field, value), by document and field order."""
    fields = F.array(*(F.struct(F.lit(i).alias("field_seq"), F.lit(f).alias("field"), attr(f).alias("value")) for i, f in enumerate(NAV_FIELDS)))
    rows = elements.where(F.col("tag").isin(*NAV_TAGS)).select("statement_id", "elem_seq", F.col("tag").alias("section"), attr("currency").alias("currency"), attr("reportDate").alias("report_date"), F.explode(F.filter(fields, lambda f: f["value"].isNotNull())).alias("f"))
    rows = rows.select("statement_id", "elem_seq", F.col("f.field_seq").alias("field_seq"), "section", F.col("f.field").alias("field"), F.col("f.value").alias("value"), "currency", "report_date")
    first = Window.partitionBy("statement_id", "section", "field", "value").orderBy("elem_seq", "field_seq")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def report_dates(elements: DataFrame) -> DataFrame:
    values = F.filter(F.array(*(attr(d) for d in DATES)), lambda v: v.isNotNull())
    return elements.groupBy("statement_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size(values) > 0, values))))).alias("report_dates"))


def base_currency(elements: DataFrame) -> DataFrame:
    """The first baseCurrency, else the first statement's currency, else that of the last NAV candidate."""
    named = attr("baseCurrency")
    is_statement = F.col("tag") == "FlexStatement"
    first = elements.groupBy("statement_id").agg(F.min_by(named, F.when(named.isNotNull(), F.col("elem_seq"))).alias("a"), F.min_by(attr("currency"), F.when(is_statement, F.col("elem_seq"))).alias("b"))
    last = nav_candidates(elements).groupBy("statement_id").agg(F.max_by("currency", F.struct("elem_seq", "field_seq")).alias("c"))
    return first.join(last, "statement_id", "left").select("statement_id", F.coalesce("a", "b", "c").alias("base_currency"))


def summarize_statements(elements: DataFrame, include_positions: bool = False) -> DataFrame:
    """One row per statement: report_type, report_dates, base_currency, nav_candidates, cash and, if asked, positions.

    One aggregation by statement gathers what each part needs of an element, so the elements are read once; a
    statement's lists are then sorted, and repeated candidates dropped, in its row.
    """
    good = elements.where("error is null") if "error" in elements.columns else elements
    tag, seq, named = F.col("tag"), F.col("elem_seq"), attr("baseCurrency")
    candidates = F.array(*(F.struct(F.col("tag").alias("section"), F.lit(f).alias("field"), attr(f).alias("value"), seq.alias("elem_seq"), F.lit(i).alias("field_seq"), attr("currency").alias("currency"), attr("reportDate").alias("report_date")) for i, f in enumerate(NAV_FIELDS)))
    dates = F.filter(F.array(*(attr(d) for d in DATES)), lambda v: v.isNotNull())
    is_cash = (tag == "CashReportCurrency") & attr("endingCash").isNotNull()
    rows = good.select("statement_id", "tag", "elem_seq", named.alias("named"), F.when(tag == "FlexStatement", attr("currency")).alias("own_currency"), F.when(F.size(dates) > 0, dates).alias("dates"), F.when(tag.isin(*NAV_TAGS), F.filter(candidates, lambda c: c["value"].isNotNull())).alias("nav"), F.when(is_cash, F.struct(seq, F.coalesce(F.col("attrs")["currency"], F.lit("unknown")).alias("currency"), attr("endingCash").alias("ending_cash"))).alias("cash"), F.when(tag == "OpenPosition", F.struct(seq, *(attr(a).alias(a) for a in POSITION))).alias("position"))
    kept = {"all_dates": F.collect_list("dates"), "nav": F.collect_list("nav"), "cash": F.collect_list("cash")} | ({"positions": F.collect_list("position")} if include_positions else {})
    whole = rows.groupBy("statement_id").agg(F.min_by("tag", "elem_seq").alias("report_type"), F.min_by("named", F.when(F.col("named").isNotNull(), seq)).alias("a"), F.min_by("own_currency", F.when(tag == "FlexStatement", seq)).alias("b"), *(c.alias(n) for n, c in kept.items()))
    # Sorted by section, field and value, the first of equal candidates stands before the others.
    ordered = whole.withColumn("nav", F.array_sort(F.flatten("nav")))
    same = lambda x, y: (x["section"] == y["section"]) & (x["field"] == y["field"]) & (x["value"] == y["value"])
    firsts = F.filter("nav", lambda x, i: (i == 0) | ~same(x, F.get("nav", F.greatest(i - 1, F.lit(0)))))
    ordered = ordered.withColumn("nav", F.array_sort(F.transform(firsts, lambda x: F.struct(x["elem_seq"].alias("elem_seq"), x["field_seq"].alias("field_seq"), F.struct(x["section"].alias("section"), x["field"].alias("field"), x["value"].alias("value"), x["currency"].alias("currency"), x["report_date"].alias("report_date")).alias("item")))))
    full = lambda c: F.when(F.size(c) > 0, c)
    without_seq = lambda name, fields: full(F.transform(F.array_sort(name), lambda x: F.struct(*(x[f].alias(f) for f in fields))))
    last = F.try_element_at("nav", F.lit(-1))["item"]["currency"]
    parts = [F.array_sort(F.array_distinct(F.flatten("all_dates"))).alias("report_dates"), F.coalesce("a", "b", last).alias("base_currency"), full(F.transform("nav", lambda x: x["item"])).alias("nav_candidates"), without_seq("cash", ("currency", "ending_cash")).alias("cash")]
    if include_positions:
        parts.append(without_seq("positions", POSITION).alias("positions"))
    return ordered.select("statement_id", "report_type", *parts)


def positions_in_base(elements: DataFrame) -> DataFrame:
    """Values in the base currency by asset category and currency, with subtotals (level 0: both, 1: category, 3: all)."""
    value = F.col("positionValue").try_cast("decimal(28,6)") * F.coalesce(F.col("fxRateToBase").try_cast("decimal(18,6)"), F.lit(1))
    rows = positions(elements).select("statement_id", F.col("assetCategory").alias("asset_category"), "currency", value.cast("decimal(38,6)").alias("value"))
    rolled = rows.groupBy("statement_id", "asset_category", "currency").agg(F.sum("value").alias("value"))
    # A sum goes into that of each level, so the positions are read once and, dealt by statement, need no further shuffle.
    none = F.lit(None).cast("string")
    level = lambda i, category, currency: F.struct(F.lit(i).alias("level"), F.col("asset_category").alias("asset_category") if category else none.alias("asset_category"), F.col("currency").alias("currency") if currency else none.alias("currency"))
    rows = rolled.select("statement_id", "value", F.explode(F.array(level(0, True, True), level(1, True, False), level(3, False, False))).alias("x"))
    return rows.groupBy("statement_id", F.col("x.asset_category").alias("asset_category"), F.col("x.currency").alias("currency"), F.col("x.level").alias("level")).agg(F.sum("value").alias("value"))


def nav_share(held: DataFrame) -> DataFrame:
    """Each position's share of its statement's total beside the share reported."""
    value = F.col("positionValue").try_cast("double") * F.coalesce(F.col("fxRateToBase").try_cast("double"), F.lit(1.0))
    rows = held.select("statement_id", "elem_seq", value.alias("value"), F.col("percentOfNAV").try_cast("double").alias("reported"))
    total = F.sum("value").over(Window.partitionBy("statement_id"))
    return rows.select("statement_id", "elem_seq", (100 * F.col("value") / F.nullif(total, F.lit(0.0))).alias("share"), "reported")


def triage_responses(log: DataFrame) -> DataFrame:
    """Adds outcome: ready, transient or fatal, by source and code."""
    transient = F.lit(False)
    for source, codes in TRANSIENT.items():
        transient = F.when(F.col("source") == source, F.col("code").isin(*codes)).otherwise(transient)
    return log.withColumn("outcome", F.when(F.col("code").isin("ok", "200"), "ready").when(transient, "transient").otherwise("fatal"))


def latest_attempt(log: DataFrame, waits: tuple[int, ...] = (2, 4, 8, 12, 20)) -> DataFrame:
    """Per request its last outcome, the attempts used, the next wait, and whether it was given up. log: outcome."""
    last = log.groupBy("request_id").agg(F.max("attempt").alias("attempts"), F.max_by("outcome", F.struct("attempt", "ts")).alias("outcome"))
    wait = F.when((F.col("outcome") == "transient") & (F.col("attempts") <= len(waits)), F.try_element_at(F.array(*map(F.lit, waits)), F.col("attempts")))
    return last.select("request_id", "attempts", "outcome", wait.alias("next_wait"), ((F.col("outcome") == "fatal") | ((F.col("outcome") == "transient") & (F.col("attempts") > len(waits)))).alias("given_up"))
