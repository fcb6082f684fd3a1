"""Agreement between the documents of a case, field by field.

Every operator here works on *distinct* values per group, counted before any
grouping, so copies of one value cost one row however many documents carry it.
Fields whose agreement is an equivalence (dates, numbers, gender, …) need no
more than a grouping on a canonical form. Names and addresses agree in a way
that is not transitive: groups of few distinct values fold in one array, larger
ones go through rounds (``_rounds``) or tiles (``support``) that stay exact and
bounded per task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dossier import policy
from dossier.functions.dates import date_text
from dossier.functions.text import address_tokens, address_tokens_agree, name_tokens, name_tokens_agree, once
from dossier.operators.listing import joined_text, label_of, top_n_within
from dossier.session import cut, settle

FOLD_VALUES = 64      # distinct values a single array may hold
ROUND_LEADERS = 256   # leaders settled per round in larger groups
FIELD_LABEL_NAMES = tuple(policy.FIELD_LABELS)


def is_fuzzy(field: Column) -> Column:
    return field.isin(*policy.NAME_FIELDS, "address")


def canonical(field: Column, value: Column) -> Column:
    """Equal forms agree; outside names and addresses only equal forms do."""
    return (
        F.when(field.isin(*policy.NAME_FIELDS), F.array_join(name_tokens(value), " "))
        .when(field == "address", F.array_join(address_tokens(value), " "))
        .when(field.isin(*policy.DATE_FIELDS), F.coalesce(date_text(value), F.trim(value)))
        .otherwise(F.upper(F.trim(value))))


def _tokens(form: Column) -> Column:
    return F.array_remove(F.split(form, " "), "")


def tokens_agree(field: Column, a: Column, b: Column) -> Column:
    """Agreement of two token arrays of a name or address field."""
    return F.when(field == "address", address_tokens_agree(a, b)).otherwise(name_tokens_agree(a, b))


def forms_agree(field: Column, a: Column, b: Column) -> Column:
    """Agreement of two canonical forms of one field; equal forms of tokens agree without a look at them."""
    return F.when((a == b) & (a != ""), True).when(
        is_fuzzy(field), once(lambda x, y: tokens_agree(field, x, y), _tokens(a), _tokens(b))).otherwise(a == b)


def values_agree(field: Column, a: Column, b: Column) -> Column:
    return forms_agree(field, canonical(field, a), canonical(field, b))


def type_key(field: Column, document_type: Column) -> Column:
    """Numbers and validity dates compare within one document type only."""
    kind = F.lower(F.trim(F.coalesce(document_type, F.lit("other"))))
    return F.when(field.isin(*policy.TYPE_SCOPED_FIELDS), kind).otherwise("")


def field_values(fields: DataFrame) -> DataFrame:
    """Distinct canonical values per (case, field, type key), with document count and first document.

    ``fields``: case_id, document_id, document_type, file_name, doc_ord, field_name, value.
    """
    field, value = F.col("field_name"), F.col("value")
    return (
        fields.filter(F.coalesce(value, F.lit("")) != "")
        .select("case_id", "field_name", type_key(field, F.col("document_type")).alias("type_key"),
                canonical(field, value).alias("form"), F.struct("doc_ord", "document_id").alias("pos"), "value")
        .groupBy("case_id", "field_name", "type_key", "form")
        .agg(F.count("*").alias("n"), F.min(F.struct("pos", "value")).alias("first")))


# ---- clusters -------------------------------------------------------------------

def _fold(items: Column, field: Column) -> Column:
    """Leaders of an ordered array of values: each one that agrees with no earlier leader."""
    def step(leaders: Column, item: Column) -> Column:
        known = F.exists(leaders, lambda l: tokens_agree(field, l["tokens"], item["tokens"]))
        return F.when(known, leaders).otherwise(F.concat(leaders, F.array(item)))

    return F.aggregate(items, F.slice(items, 1, 0), step)


def _first_agreeing(leaders: Column, field: Column, tokens: Column) -> Column:
    found = F.try_element_at(F.filter(leaders, lambda l: tokens_agree(field, l["tokens"], tokens)), F.lit(1))
    return F.when(found.isNotNull(), F.struct(found["first"].alias("first"), found["form"].alias("form")))


def _collected(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ordered array per group, of values as they are."""
    return values.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "form", "n"))).alias("_items"))


def _with_tokens(collected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return collected.select(*keys, F.transform("_items", lambda i: F.struct(
        i["first"].alias("first"), i["form"].alias("form"), i["n"].alias("n"), _tokens(i["form"]).alias("tokens")))
        .alias("items"))


def _ordered(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ordered array per group; callers bound the size of the groups."""
    # tokens follow from the form, so they are made after the rows have moved
    return _with_tokens(_collected(values, keys), keys)


def _rounds(values: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Clusters of groups too large for one array.

    Each round takes the earliest undecided values of every group, settles the
    leaders among them and gives every remaining value that agrees to the first
    such leader. What agrees with none comes later than all of them, so the
    outcome is that of the sequential rule.
    """
    settled, open_values = [], values
    field = F.col("field_name")
    while not open_values.isEmpty():
        front = top_n_within(open_values, keys, [F.col("first")], ROUND_LEADERS).drop("rank")
        leaders = _ordered(front, keys).select(*keys, _fold(F.col("items"), field).alias("leaders"))
        judged = cut(open_values.join(leaders, list(keys)).select(
            *values.columns, once(lambda t: _first_agreeing(F.col("leaders"), field, t), _tokens(F.col("form"))).alias("leader")))
        settled.append(judged.filter(F.col("leader").isNotNull()))
        open_values = judged.filter(F.col("leader").isNull()).drop("leader")
    return settled


def clusters(values: DataFrame, keys: Sequence[str] = ("case_id", "field_name", "type_key")) -> DataFrame:
    """Values with the leader of their agreement cluster: ``leader`` struct(first, form).

    Null leaders mark values without tokens, which agree with nothing: every
    document carrying one is a cluster of its own. ``begun`` counts the clusters
    that start at a value. Only names and addresses are written, as several steps
    pass over them; the others stay a plan, so what a reader leaves out (``first``)
    is never made.
    """
    plain, fuzzy = cluster_parts(values, keys)
    return plain.unionByName(fuzzy)


def cluster_parts(values: DataFrame, keys: Sequence[str] = ("case_id", "field_name", "type_key"),
                  together: bool = False) -> list[DataFrame]:
    """``clusters`` in two parts that share no group: equal forms only, and names and addresses.

    With ``together`` the caller says that the values of a group are in one task and bounded: groups are then
    written as arrays where they are and move no more.
    """
    keys = list(keys)
    fuzzy, empty = is_fuzzy(F.col("field_name")), F.col("form") == ""
    plain_leader = F.struct("first", "form")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    plain = values.filter(~fuzzy).withColumn("leader", plain_leader).withColumn("begun", one)
    if together:
        groups = cut(_collected(values.filter(fuzzy), keys))
        kept = groups.select(*keys, F.inline("_items")).select(*values.columns)
        full = groups.withColumn("_items", F.filter("_items", lambda i: i["form"] != "")).filter(F.size("_items") > 0)
        # a group without a key has no rounds, as rows meet by their keys there
        big = F.size("_items") > FOLD_VALUES
        for key in keys:
            big = big & F.col(key).isNotNull()
        sizes = full.filter(big)
        large = [] if sizes.isEmpty() else _rounds(sizes.select(*keys, F.inline("_items")).select(*values.columns), keys)
        small = _with_tokens(full.filter(~big), keys)
    else:
        kept = cut(values.filter(fuzzy))
        open_values = kept.filter(~empty)
        sizes = open_values.groupBy(*keys).agg(F.count("*").alias("_v")).filter(F.col("_v") > FOLD_VALUES).drop("_v")
        large = [] if sizes.isEmpty() else _rounds(cut(open_values.join(sizes, keys, "left_semi")), keys)
        small = _ordered(open_values.join(sizes, keys, "left_anti") if large else open_values, keys)
    bare = kept.filter(empty).withColumn("leader", F.when(F.lit(False), plain_leader)).withColumn("begun", F.col("n").cast("long"))
    field = F.col("field_name")
    folded = small.withColumn("leaders", _fold(F.col("items"), field)).select(
        *keys, "leaders", F.explode("items").alias("item")).select(
        *keys, F.col("item.form").alias("form"), F.col("item.n").alias("n"), F.col("item.first").alias("first"),
        _first_agreeing(F.col("leaders"), field, F.col("item.tokens")).alias("leader"))
    out = bare.select(*plain.columns)
    for part in [folded, *large]:
        out = out.unionByName(part.withColumn(
            "begun", F.when(F.col("leader").isNull(), F.col("n").cast("long")).when(F.col("form") == F.col("leader.form"), one)
            .otherwise(none)).select(*plain.columns))
    return [plain, out]


def consistency(clustered: DataFrame, *more: DataFrame) -> DataFrame:
    """One finding per field (and type, where scoped) that at least two documents carry.

    ``more`` are parts that share no group with the others (``cluster_parts``): each is summed on its own, so one that
    has its groups together moves nothing.
    """
    if more:
        out = consistency(clustered)
        for part in more:
            out = out.unionByName(consistency(part))
        return out
    field, kind = F.col("field_name"), F.col("type_key")
    label = label_of(field, policy.FIELD_LABELS)
    severities = [F.lit(p) for item in policy.CONFLICT_SEVERITY.items() for p in item]
    severity = F.coalesce(F.try_element_at(F.create_map(*severities), field), F.lit("medium"))
    grouped = clustered.filter(field.isin(*FIELD_LABEL_NAMES)).groupBy("case_id", "field_name", "type_key").agg(
        F.sum("n").alias("n_documents"), F.sum("begun").alias("n_clusters"))
    same = F.when(
        kind != "", F.concat(label, F.lit(" is consistent across the "), F.col("n_documents").cast("string"), F.lit(" "),
                             F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" document(s)."))) \
        .otherwise(F.concat(label, F.lit(" is consistent across all "), F.col("n_documents").cast("string"),
                            F.lit(" documents.")))
    agree = F.col("n_clusters") == 1
    return grouped.filter(F.col("n_documents") >= 2).select(
        "case_id", "field_name", "type_key", F.when(agree, "info").otherwise(severity).alias("severity"),
        "n_documents", "n_clusters",
        F.when(agree, same).otherwise(F.concat(label, F.lit(" differs across submitted documents.")))
        .alias("explanation"))


def finding_members(fields: DataFrame, clustered: DataFrame) -> DataFrame:
    """Documents behind each finding with the cluster they fell into (long form of the involved list)."""
    field = F.col("field_name")
    rows = fields.filter(F.coalesce("value", F.lit("")) != "").select(
        "case_id", "field_name", type_key(field, F.col("document_type")).alias("type_key"),
        canonical(field, F.col("value")).alias("form"), "document_id", "file_name", "doc_ord", "value")
    lead = clustered.select("case_id", "field_name", "type_key", "form", F.col("leader.first.pos").alias("lead_pos"),
                            F.col("leader.first.value").alias("lead_value"))
    own = F.struct("doc_ord", "document_id")
    return rows.join(lead, ["case_id", "field_name", "type_key", "form"]).select(
        "case_id", "field_name", "type_key", "document_id", "file_name", "doc_ord", "value",
        F.coalesce("lead_pos", own).alias("cluster"), F.coalesce("lead_value", "value").alias("cluster_value"))


def conflict_parts(members: DataFrame, findings: DataFrame) -> DataFrame:
    """The wording of conflicts, one row per cluster: ``files → value``.

    A cluster of more than a thousand documents takes several rows.
    """
    keys = ["case_id", "field_name", "type_key"]
    conflicts = findings.filter(F.col("severity") != "info").select(*keys)
    rows = members.join(conflicts, keys, "left_semi")
    named = joined_text(rows, [*keys, "cluster", "cluster_value"], "file_name", ["doc_ord", "document_id"], ", ")
    return named.select(*keys, F.col("cluster.doc_ord").alias("cluster_ord"),
                        F.col("cluster.document_id").alias("cluster_document"), "part_no",
                        F.concat("text", F.lit(" → "), "cluster_value").alias("part"))


# ---- reference value and comparison table ------------------------------------------

def support(values: DataFrame) -> DataFrame:
    """Values with ``agreeing``: how many documents of the group agree with each."""
    plain, fuzzy = support_parts(values)
    return plain.unionByName(fuzzy)


def support_parts(values: DataFrame, together: bool = False) -> list[DataFrame]:
    """``support`` in two parts that share no group, as in ``cluster_parts``.

    With ``together`` the caller says that ``values`` are a written table with the values of a case in one task: they
    are read from there and move no more.
    """
    keys = ["case_id", "field_name", "type_key"]
    fuzzy, empty, field = is_fuzzy(F.col("field_name")), F.col("form") == "", F.col("field_name")
    plain = values.filter(~fuzzy).withColumn("agreeing", F.col("n"))
    kept = values.filter(fuzzy) if together else cut(values.filter(fuzzy))
    open_values = kept.filter(~empty)

    def total(items: Column, tokens: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), lambda s, i: s + F.when(
            tokens_agree(field, i["tokens"], tokens), i["n"]).otherwise(F.lit(0).cast("long")))

    sizes = open_values.groupBy(*keys).agg(F.count("*").alias("_v")).filter(F.col("_v") > FOLD_VALUES)
    has_large = not sizes.isEmpty()
    # a value without tokens, one at most in a group, agrees with none
    small = kept.join(sizes, keys, "left_anti") if has_large else kept
    out = _ordered(small, keys).select(*keys, "items", F.explode("items").alias("item")).select(
        *keys, F.col("item.form").alias("form"), F.col("item.n").alias("n"), F.col("item.first").alias("first"),
        total(F.col("items"), F.col("item.tokens")).alias("agreeing")).select(*plain.columns)
    if has_large:
        bare = kept.filter(empty).join(sizes, keys, "left_semi").withColumn("agreeing", F.lit(0).cast("long"))
        # tiles of bounded arrays meet each value of the group; partial counts are then added up
        spread = F.pmod(F.xxhash64("form"), F.ceil(F.col("_v") / FOLD_VALUES)).cast("int")
        tiled = open_values.join(sizes, keys).withColumn("tile", spread)
        tiles = _ordered(tiled, [*keys, "tile"]).select(*keys, "items")
        partial = open_values.join(sizes.drop("_v"), keys, "left_semi").join(tiles, keys).select(
            *kept.columns, once(lambda t: total(F.col("items"), t), _tokens(F.col("form"))).alias("part"))
        summed = partial.groupBy(*keys, "form").agg(
            F.first("n").alias("n"), F.first("first").alias("first"), F.sum("part").alias("agreeing"))
        out = out.unionByName(bare.select(*plain.columns)).unionByName(summed.select(*plain.columns))
    return [plain, out]


def reference_value(supported: DataFrame) -> DataFrame:
    """Per (case, field) the value that agrees with most documents; the earliest of equals.

    Documents of other types count as agreeing for type-scoped fields.
    """
    keys = ["case_id", "field_name"]
    by_type = supported.dropna(subset=keys).groupBy(*keys, "type_key").agg(
        F.sum("n").alias("_t"),
        F.min(F.struct((-F.col("agreeing")).alias("neg"), "first", "form")).alias("_best"))
    # documents of other types are all documents less those of the own type; all are one number for a field, so they
    # change no order and come off after the choice, and the values are read once
    score = F.struct((F.col("_best.neg") + F.col("_t")).alias("rest"), F.col("_best.first").alias("first"),
                     F.col("_best.form").alias("form"), "type_key")
    scored = by_type.groupBy(*keys).agg(
        F.min(score).alias("ref"), F.sum("_t").alias("n_values"), F.max("_t").alias("n_same_type"))
    agreed = F.col("ref.rest") < F.col("n_values")
    return scored.select(
        *keys, "n_values", "n_same_type", F.when(agreed, F.col("ref.form")).alias("ref_form"),
        F.col("ref.type_key").alias("ref_type"), F.when(agreed, F.trim(F.col("ref.first.value"))).alias("reference_value"))


def comparison(supported: DataFrame, findings: DataFrame) -> DataFrame:
    """Per (case, field): reference value, disagreeing documents and status.

    ``n_values`` counts rows of a field; a field occurs once per document.
    """
    keys = ["case_id", "field_name"]
    ref = reference_value(supported)
    field = F.col("field_name")
    agrees = F.when(F.col("ref_form").isNull(), True).when(F.col("type_key") != F.col("ref_type"), True) \
        .otherwise(forms_agree(field, F.col("form"), F.col("ref_form")))
    rows = supported.join(ref, keys).groupBy(*keys).agg(
        F.first("n_values").alias("n_values"), F.first("n_same_type").alias("n_same_type"),
        F.first("reference_value").alias("reference_value"),
        F.sum(F.when(agrees, 0).otherwise(F.col("n"))).alias("n_disagree"))
    last = findings.groupBy(*keys).agg(
        F.max_by(F.struct("severity", "explanation"), "type_key").alias("finding"))
    comparable = F.when(field.isin(*policy.TYPE_SCOPED_FIELDS), F.col("n_same_type")).otherwise(F.col("n_values"))
    label = label_of(field, policy.FIELD_LABELS)
    mismatch = (F.col("n_disagree") > 0) & F.col("finding").isNotNull() & (F.col("comparable") >= 2)
    return rows.join(last, keys, "left").withColumn("comparable", comparable).select(
        *keys, label.alias("label"), "reference_value", "n_values", "n_disagree", "comparable",
        F.when(mismatch, "mismatch").when(F.col("comparable") >= 2, "consistent").otherwise("single_source")
        .alias("status"),
        F.when(mismatch, F.when(F.col("finding.severity").isin("medium", "high"), F.col("finding.severity"))
               .otherwise("medium")).alias("severity"),
        F.when(mismatch, F.col("finding.explanation"))
        .when(F.col("comparable") >= 2, F.concat(label, F.lit(" is consistent across all "),
                                                 F.col("comparable").cast("string"), F.lit(" comparable documents.")))
        .alias("explanation"))


def field_names(fields: DataFrame) -> DataFrame:
    return fields.select("case_id", "field_name").distinct()


def name_versus_first(fields: DataFrame, field_name: str = "full_name") -> DataFrame:
    """Each name of a case against the first one."""
    own = fields.filter((F.col("field_name") == field_name) & (F.coalesce("value", F.lit("")) != ""))
    first = own.groupBy("case_id").agg(
        F.min_by("value", F.struct("doc_ord", "document_id")).alias("first_value"))
    # the form of the first value is made once a case, that of the others once a row and only where they differ from it
    field, value = F.lit(field_name), F.col("value")
    met = own.join(first.withColumn("_first", canonical(field, F.col("first_value"))), "case_id")
    formed = settle(met, "_form", F.when(value == F.col("first_value"), F.col("_first")).otherwise(canonical(field, value)))
    return formed.select("case_id", "document_id", "value", "first_value",
                         forms_agree(field, F.col("_first"), F.col("_form")).alias("agrees"))
