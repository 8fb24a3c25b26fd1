"""Data-quality profiles: one pass of conditional counts, and reconciliations as joins of aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import duplicates


def profile(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], usable: Column | None = None) -> DataFrame:
    """(check, observed) rows: rows, duplicate keys, and per rule the rows that break it, or the sum of a rule that counts cells.

    Rows that are not `usable` are counted as rows, and by rules that don't ask for it, but not as duplicates.
    """
    counts = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.coalesce(c.cast("long"), F.lit(0))), F.lit(0)).alias(n) for n, c in rules.items()])
    repeated = duplicates(df if usable is None else df.filter(usable), keys).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_keys"))
    wide = counts.join(F.broadcast(repeated), F.lit(True))
    names = ["rows", "duplicate_keys", *rules]
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("observed")) for n in names])))


NPI = "^[0-9]{10}$"


def not_like(value: Column, pattern: str) -> Column:
    return ~F.coalesce(F.trim(value).rlike(pattern), F.lit(False))


def not_in(value: Column, *allowed: str) -> Column:
    return ~F.coalesce(F.trim(value).isin(*allowed), F.lit(False))


def _each(columns: Sequence[str], test) -> Column:
    """In how many of the columns the test holds."""
    return sum((F.coalesce(test(c), F.lit(False)).cast("long") for c in columns), F.lit(0))


def supplier_profile(df: DataFrame, npi: str, entity: str, beneficiaries: str, required: Sequence[str], optional: Sequence[str], counts: Sequence[str] = (), shares: Sequence[str] = (), age: str | None = None, malformed: Column | None = None) -> DataFrame:
    """Profile of a supplier file whose cells are text: ids, entity codes, numbers, suppressed cells, shares above one.

    Required numbers must not be blank; optional ones may be blank or marked as suppressed by * or #. A number is invalid
    if it can't be read, is negative, is a count with a fraction, or an age above 120. Shares above one are only counted.
    Malformed rows are counted and not looked at further.
    """
    broken = F.coalesce(malformed, F.lit(False)) if malformed is not None else F.lit(False)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    hidden = lambda c: text(c).isin("*", "#") if c in optional else F.lit(False)
    number = lambda c: F.when(text(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text(c).try_cast("double"))
    unreadable = lambda c: (text(c) != "") & ~hidden(c) & (number(c).isNull() | (F.abs(number(c)) == float("inf")))
    every = [*required, *optional]
    invalid = _each(every, unreadable) + _each(every, lambda c: number(c) < 0) + _each([c for c in required if c != beneficiaries], lambda c: text(c) == "") + _each(counts, lambda c: (number(c) >= 0) & (number(c) != F.floor(number(c))))
    if age:
        invalid = invalid + _each([age], lambda c: number(c) > 120)
    rules = {
        "invalid_npi": not_like(F.col(npi), NPI), "invalid_entity": not_in(F.col(entity), "I", "O"), "invalid_numbers": invalid, "suppressed_numbers": _each(every, hidden),
        "unknown_beneficiaries": (text(beneficiaries) == "") | hidden(beneficiaries), "shares_above_one": _each(shares, lambda c: number(c) > 1),
    }
    return profile(df, [npi], {"malformed_rows": broken, **{n: F.when(~broken, c.cast("long")) for n, c in rules.items()}}, ~broken)


def schema_difference(columns: Sequence[str], expected: Sequence[str]) -> list[str]:
    """Columns that are missing, not expected, or not in their place."""
    off = [c for c, e in zip(columns, expected, strict=False) if c != e]
    return sorted({*(set(columns) ^ set(expected)), *off})


def service_profile(df: DataFrame, keys: Sequence[str], expected: Sequence[str], patterns: Mapping[str, str], domains: Mapping[str, Sequence[str]], numbers: Sequence[str], suppressible: str, filters: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """Profile of a detail file: columns in order, id patterns, domains, nonnegative numbers, suppressed rows, filter replay, grain."""
    wrong = {f"invalid_{c}": not_like(F.col(c), p) for c, p in patterns.items()} | {f"invalid_{c}": not_in(F.col(c), *v) for c, v in domains.items()}
    negative = _each(numbers, lambda c: (F.col(c) < 0) | F.col(c).isNull() | F.isnan(F.col(c).cast("double")))
    off = F.lit(len(schema_difference(df.columns, expected))).cast("long")
    found = profile(df, keys, {"suppressed": F.col(suppressible).isNull(), **wrong, "invalid_numbers": negative, "filter_mismatch": filter_mismatch(filters)})
    return found.unionByName(df.sparkSession.range(1).select(F.lit("columns_out_of_place").alias("check"), off.alias("observed")))


def provider_profile(df: DataFrame, npi: str, required: Sequence[str], filters: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """Profile of a provider file: rows without a required value, ids that are malformed or repeated, rows outside the selection."""
    return profile(df, [npi], {"missing_required": _each(required, lambda c: F.col(c).isNull()) > 0, "invalid_npi": not_like(F.col(npi), NPI), "filter_mismatch": filter_mismatch(filters)})


def filter_mismatch(filters: Mapping[str, tuple[Column, Sequence[str]]]) -> Column:
    """Rows outside the selection a file was retrieved with."""
    miss = F.lit(False)
    for c, allowed in filters.values():
        miss = miss | ~F.coalesce(F.upper(c).isin([a.upper() for a in allowed]), F.lit(False))
    return miss


def geography_rule(level: Column, code: Column, description: Column) -> Column:
    """Breaks: a national row has a blank code and says so; a state row has a two-character code and a description."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    national = blank(code) & (description == "National")
    return ~F.coalesce(F.when(level == "National", national).when(level == "State", code.rlike("^[0-9A-Z]{2}$") & ~blank(description)).otherwise(False), F.lit(False))


def relationship_profile(df: DataFrame, fields: str, record_id: str, year_field: str, year: str, filters: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Profile of rows that are maps of text fields, whose names are matched without regard to case.

    Counts blank and repeated record ids, other years, fields with another value than the filters', rows without a
    required field, and rows with two fields whose names differ only in case.
    """
    keys = F.transform(F.map_keys(fields), lambda k: F.lower(k))
    value = lambda name: F.get(F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]
    rows = df.withColumn("__id", F.trim(F.coalesce(value(record_id), F.lit(""))))
    need = F.array(*[F.lit(c.lower()) for c in sorted({record_id, year_field, *required, *filters})])
    outside = sum((F.coalesce((value(k) != v), F.lit(True)).cast("long") for k, v in filters.items()), F.lit(0))
    rules = {
        "blank_ids": F.col("__id") == "", "year_mismatch": F.coalesce(value(year_field) != year, F.lit(True)), "filter_mismatch": outside,
        "missing_required": F.size(F.array_except(need, keys)) > 0, "case_collisions": F.size(F.array_distinct(keys)) < F.size(keys),
    }
    return profile(rows, ["__id"], rules, F.col("__id") != "")


def status_profile(df: DataFrame, requested: DataFrame, key: str, enrollment: str, flag: str, reason: str, dates: Sequence[str]) -> DataFrame:
    """Profile of an enrollment or revocation snapshot: ids of 15 letters or digits without repeats, flags, reasons, ISO dates, ids not asked for."""
    asked = requested.select(key).distinct().withColumn("__asked", F.lit(True))
    rows = df.join(asked, key, "left")
    iso = lambda c: F.when(F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd")).isNull()
    rules = {
        "not_requested": F.col("__asked").isNull(), "invalid_enrollment": not_like(F.col(enrollment), "^[A-Za-z0-9]{15}$"), "invalid_flag": not_in(F.col(flag), "Y", "N"),
        "missing_reason": F.coalesce(F.col(reason), F.lit("")) == "", "invalid_dates": _each(dates, iso),
    }
    return profile(rows, [enrollment], rules)


def requested_status(found: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested ids with whether the snapshot has them."""
    return requested.select(key).distinct().join(found.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").select(key, F.when(F.col("hit"), "matched").otherwise("missing").alias("state"))


def page_reconcile(pages: DataFrame, rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Declared against actual rows per page, and bytes and hash where `files` has what was stored, with the expected offset of each page."""
    actual = rows.groupBy("page").agg(F.count("*").alias("actual_rows"))
    both = pages.join(actual, "page", "full_outer")
    order = Window.orderBy("page")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("declared_rows")).over(order), F.lit(0))
    stored = F.lit(None).cast("string")
    if files is not None:
        both = both.join(files.select("page", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256")), "page", "left")
        stored = F.when(F.col("actual_bytes").isNull(), "no-file").when(F.col("bytes") != F.col("actual_bytes"), "byte-count").when(F.col("sha256") != F.col("actual_sha256"), "hash")
    problem = F.when(F.col("declared_rows").isNull(), "unlisted-page").when(F.col("actual_rows").isNull(), "no-rows").when(F.col("declared_rows") != F.col("actual_rows"), "row-count")
    return both.withColumn("expected_offset", expected).withColumn("problem", F.coalesce(problem, F.when(F.col("offset") != F.col("expected_offset"), "offset-gap"), stored, F.lit("ok")))


def page_total(reconciled: DataFrame) -> DataFrame:
    """One row: pages, declared and actual rows, pages with a problem, and whether the inventory holds."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return reconciled.agg(F.count("*").alias("pages"), n("declared_rows"), n("actual_rows"), F.count_if(F.col("problem") != "ok").alias("problems")).withColumn("valid", (F.col("problems") == 0) & (F.col("pages") > 0))


def cursor_chain(pages: DataFrame, most_rows: int) -> DataFrame:
    """Each page of a cursor chain with its running rows and what is wrong with it: broken, repeated, ended early, over the cap."""
    order = Window.orderBy("page")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.row_number().over(Window.partitionBy("cursor").orderBy("page"))
    rows = pages.withColumns({"running_rows": F.sum("rows").over(upto), "declared_next": F.lag("next_cursor").over(order), "previous": F.lag("page").over(order), "later": F.lead("page").over(order), "seen": seen})
    problem = (
        F.when(F.col("previous").isNotNull() & ~F.col("declared_next").eqNullSafe(F.col("cursor")), "broken-chain").when(F.col("seen") > 1, "repeated-cursor")
        .when(F.col("next_cursor").isNull() & F.col("later").isNotNull(), "pages-after-end").when(F.col("next_cursor").isNotNull() & F.col("later").isNull(), "no-terminal-page")
        .when(F.col("running_rows") > most_rows, "over-cap").otherwise("ok")
    )
    return rows.select("page", "cursor", "rows", "running_rows", problem.alias("problem"))


def union_reconcile(batches: DataFrame, union: DataFrame) -> DataFrame:
    """Rows per batch of a disjoint partition, and whether together they are the union."""
    per = batches.groupBy("batch").agg(F.count("*").alias("rows"))
    whole = union.agg(F.count("*").alias("union_rows"))
    total = Window.partitionBy(F.lit(1))
    return per.join(F.broadcast(whole), F.lit(True)).withColumn("reconciled", F.sum("rows").over(total) == F.col("union_rows"))


def load_reconcile(facts: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Rows declared by the succeeded run against the rows that are there."""
    actual = facts.groupBy(key).agg(F.count("*").alias("actual_rows"))
    both = runs.join(actual, key, "full_outer")
    state = F.when(F.col("loaded_rows").isNull(), "no-run").when(F.col("actual_rows").isNull(), "no-rows").when(F.col("loaded_rows") == F.col("actual_rows"), "match").otherwise("mismatch")
    return both.select(key, "loaded_rows", "actual_rows", state.alias("state"))


def file_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each listed file: missing, other size, other hash, or as listed."""
    found = files.select("name", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    both = manifest.join(found, "name", "left")
    state = F.when(F.col("found_bytes").isNull(), "missing").when(F.col("bytes") != F.col("found_bytes"), "size-mismatch").when(F.col("sha256") != F.col("found_sha256"), "hash-mismatch").otherwise("match")
    return both.select("name", "bytes", "found_bytes", state.alias("state"))


def status_rollup(status: DataFrame, release: str) -> DataFrame:
    """Per release and overall (null): files and how many are in each state; complete, incomplete or mismatched."""
    n = {k: F.count_if(F.col("state") == k).alias(k.replace("-", "_")) for k in ("match", "missing", "size-mismatch", "hash-mismatch")}
    rolled = status.rollup(release).agg(F.grouping(release).cast("boolean").alias("overall"), F.count("*").alias("files"), *n.values())
    state = F.when(F.col("size_mismatch") + F.col("hash_mismatch") > 0, "mismatched").when(F.col("missing") > 0, "incomplete").otherwise("complete")
    return rolled.withColumn("state", state)


def rule_scan(texts: DataFrame, key: str, text: str, rules: Mapping[str, str], allowed: DataFrame | None = None) -> DataFrame:
    """(key, rule, match, times) of every pattern found in a text, without allowed matches."""
    hits = F.concat(*[F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), _tagged(n)) for n, p in rules.items()])
    found = texts.select(key, F.inline(hits)).groupBy(key, "rule", "match").agg(F.count("*").alias("times"))
    return found if allowed is None else found.join(allowed, ["rule", "match"], "left_anti")


def _tagged(rule: str):
    return lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match"))


def npi_like(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Ten-digit values whose check digit holds under the 80840 prefix; hexadecimal digests are masked first."""
    masked = F.regexp_replace(text, r"\b[0-9a-fA-F]{32,64}\b", " ")
    candidates = F.regexp_extract_all(masked, F.lit(r"(?<![0-9])[0-9]{10}(?![0-9])"), F.lit(0))
    found = texts.select(key, F.explode(candidates).alias("candidate"))
    return found.filter(F.call_function("luhn_check", F.concat(F.lit("80840"), F.col("candidate")))).groupBy(key, "candidate").agg(F.count("*").alias("times"))


def unregistered(texts: DataFrame, key: str, text: str, pattern: str, registry: DataFrame) -> DataFrame:
    """(key, token) of the tokens that the registry doesn't have."""
    tokens = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("token")).distinct()
    return tokens.join(registry.select("token").distinct(), "token", "left_anti").select(key, "token")
