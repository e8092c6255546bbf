"""Review drafts, queue synchronisation, human decisions and product finalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASSIFY_REVIEW, CLOSED_REVIEW, DECISION_ALIASES, OPEN_REVIEW
from ..functions.status import review_flow_status
from ..functions.text import first_real_brand, is_placeholder_brand, sentence, strip
from ..functions.values import stage
from ..scale import case_map
from .normalization import Vocabulary, comparison_key, normalize_values
from .validation import issue_array

DRAFT = ["product_id", "issue_type", "severity", "attribute", "current_value", "reason", "ai_value",
         "raw_value", "normalized_value", "allowed_values", "source", "evidence_text", "confidence"]
KEY = ["product_id", "issue_type", "attribute_key"]


def attribute_key(c):
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _draft(df: DataFrame, **cols) -> DataFrame:
    types = {"product_id": "long", "allowed_values": "array<string>", "confidence": "double"}
    return df.select(*[cols.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in DRAFT])


def current_value(agreement, input_value, normalized, raw):
    """A conflict shows the input candidate, anything else the normalized or raw value."""
    def filled(c):
        return F.nullif(c, F.lit(""))
    return F.when(agreement == "CONFLICT", F.coalesce(filled(input_value), raw)).otherwise(
        F.coalesce(filled(normalized), raw))


def validation_drafts(issues: DataFrame, attributes: DataFrame) -> DataFrame:
    """Drafts from reviewable validation issues (long form) beside their attribute row.

    `attributes` needs input_value for conflicts (the INPUT candidate).
    """
    rows = attributes.select(
        "product_id", F.col("label").alias("attribute"), F.col("raw_value").alias("a_raw"),
        F.col("normalized_value").alias("a_norm"), F.col("selected_source").alias("a_source"),
        F.col("evidence_text").alias("a_evidence"), "agreement", "input_value")
    return _validation_drafts(issues.where("requires_review").join(rows, ["product_id", "attribute"], "left"))


def checked_drafts(checked: DataFrame) -> DataFrame:
    """The same drafts straight from checked attributes (`validation.check_attributes`): every issue is read
    from the row of its attribute, so the rows are built once and meet no second time."""
    rows = checked.where("in_template").select(
        "product_id", F.col("label").alias("attribute"), F.col("raw_value").alias("a_raw"),
        F.col("normalized_value").alias("a_norm"), F.col("selected_source").alias("a_source"),
        F.col("evidence_text").alias("a_evidence"), "agreement", F.col("input.value").alias("input_value"),
        F.explode(issue_array()).alias("_i"))
    return _validation_drafts(rows.select("*", "_i.*").drop("_i").where("requires_review"))


def _validation_drafts(df: DataFrame) -> DataFrame:
    """Issue columns beside the attribute's a_raw, a_norm, a_source, a_evidence, agreement and input_value."""
    df = df.withColumn("_cur", current_value(F.col("agreement"), F.col("input_value"), F.col("a_norm"), F.col("a_raw")))
    return _draft(
        df, product_id=F.col("product_id"), issue_type=F.col("issue_type"), severity=F.col("severity"),
        attribute=F.col("attribute"), current_value=F.col("_cur"), reason=F.col("message"),
        ai_value=F.coalesce("_cur", "a_raw"), raw_value=F.coalesce("raw_value", "a_raw"),
        normalized_value=F.coalesce("normalized_value", "a_norm"), allowed_values=F.col("allowed_values"),
        source=F.coalesce("source", "a_source"), evidence_text=F.coalesce("evidence_text", "a_evidence"))


def draft_candidates(drafts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate values of each draft, long form: evidence first, allowed list values after."""
    own = drafts.join(candidates.withColumnRenamed("label", "attribute").select(
        "product_id", "attribute", F.col("ordinal"), F.col("value"), F.col("source").alias("c_source")),
        ["product_id", "attribute"]).select(
        "product_id", "issue_type", "attribute", F.lit(0).alias("block"), "ordinal", "value",
        F.col("c_source").alias("source"))
    listed = drafts.select("product_id", "issue_type", "attribute", F.lit(1).alias("block"),
                           F.posexplode("allowed_values").alias("ordinal", "value")).select(
        "product_id", "issue_type", "attribute", "block", F.col("ordinal").cast("long").alias("ordinal"),
        "value", F.lit("ALLOWED_LOV").alias("source"))
    return own.unionByName(listed)


def brand_drafts(products: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Needs brand_1..3, brand_candidate, brand_method, brand_match_candidate."""
    real = first_real_brand(F.col("brand_1"), F.col("brand_2"), F.col("brand_3"), extra=extra)
    desc = F.when(~is_placeholder_brand(F.col("brand_candidate"), extra), F.col("brand_candidate"))
    df = stage(products, {"_real": real, "_desc": desc})
    two = F.coalesce(F.lower(strip(F.col("_real"))) != F.lower(strip(F.col("_desc"))), F.lit(False))
    return _draft(
        df.where(two | F.coalesce(F.col("brand_method") == "brand_conflict", F.lit(False))),
        product_id=F.col("product_id"), issue_type=F.lit("BRAND_CONFLICT"), severity=F.lit("HIGH"),
        attribute=F.lit("Brand"), current_value=F.coalesce("_real", "brand_match_candidate"),
        reason=sentence("BRAND_CONFLICT"),
        ai_value=F.coalesce("_desc", "_real"))


def classification_drafts(classifications: DataFrame) -> DataFrame:
    return _draft(
        classifications.where(F.col("confidence") < CLASSIFY_REVIEW),
        product_id=F.col("product_id"), issue_type=F.lit("LOW_CLASSIFICATION_CONFIDENCE"),
        severity=F.lit("MEDIUM"), attribute=F.lit("Classification"), current_value=F.col("classpath"),
        reason=sentence("LOW_CLASSIFICATION_CONFIDENCE", F.format_string("%.2f", "confidence")),
        ai_value=F.col("classpath"), confidence=F.col("confidence"))


SOURCELESS = ["INGESTED", "DUPLICATE_CANDIDATE", "INVALID", "UNDERSTOOD", "RESOLVED", "CLASSIFIED"]


def source_drafts(products: DataFrame, sources: DataFrame) -> DataFrame:
    """No manufacturer source: by status, or because every stored source is someone else's."""
    seen = sources.groupBy("product_id").agg(F.bool_or(F.col("source_type") == "MANUFACTURER").alias("_mfr"))
    df = products.select("product_id", "status").join(seen, "product_id", "left")
    none_found = F.coalesce(~F.col("_mfr"), F.lit(False)) & ~F.col("status").isin(SOURCELESS)
    return _draft(
        df.where((F.col("status") == "NO_AUTHORITATIVE_SOURCE") | none_found),
        product_id=F.col("product_id"), issue_type=F.lit("NO_AUTHORITATIVE_SOURCE"), severity=F.lit("HIGH"),
        attribute=F.lit("Manufacturer source"), reason=sentence("NO_AUTHORITATIVE_SOURCE"))


def quota_drafts(queue: DataFrame, understood: DataFrame) -> DataFrame:
    """An open quota row stays wanted until understanding exists, or always for extraction."""
    rows = queue.where((F.col("issue_type") == "LLM_QUOTA_EXHAUSTED") & F.col("status").isin(OPEN_REVIEW))
    df = rows.join(understood.select("product_id").distinct().withColumn("_u", F.lit(True)), "product_id", "left")
    kept = df.where((F.lower(F.coalesce("stage", F.lit(""))) == "extraction") | F.col("_u").isNull())
    first = kept.groupBy("product_id").agg(F.min(F.struct("review_id", "severity", "attribute", "current_value", "reason")).alias("r"))
    return _draft(first, product_id=F.col("product_id"), issue_type=F.lit("LLM_QUOTA_EXHAUSTED"),
                  severity=F.coalesce("r.severity", F.lit("HIGH")), attribute=F.coalesce("r.attribute", F.lit("Understanding")),
                  current_value=F.col("r.current_value"), reason=F.col("r.reason"))


def deferral_rows(errors: DataFrame, products: DataFrame) -> DataFrame:
    """Queue rows for deferred runs: quota exhaustion and failed source fetches.

    `errors` has product_id, stage, error_type, message; one row per product and kind.
    """
    fetch = F.col("error_type") == "SOURCE_FETCH_FAILED"
    wanted = errors.where(fetch | (F.col("error_type") == "LLM_QUOTA_EXHAUSTED")).join(
        products.select("product_id"), "product_id", "left_semi")
    last = wanted.groupBy("product_id", "error_type").agg(F.max(F.struct("error_id", "stage", "message")).alias("e"))
    default = F.when(fetch, sentence("SOURCE_FETCH_FAILED")).otherwise(sentence("LLM_QUOTA_EXHAUSTED"))
    return _draft(last, product_id=F.col("product_id"), issue_type=F.col("error_type"), severity=F.lit("HIGH"),
                  attribute=F.when(fetch, "Manufacturer Source").otherwise(F.initcap("e.stage")),
                  reason=F.coalesce(F.nullif("e.message", F.lit("")), default))


def collect_drafts(primary: DataFrame, extras: DataFrame, queue: DataFrame) -> DataFrame:
    """Drafts minus decided keys; an extra is dropped when its key is already drafted."""
    decided = queue.where(F.col("status").isin(CLOSED_REVIEW)).select(
        "product_id", "issue_type", attribute_key(F.col("attribute")).alias("attribute_key")).distinct()
    every = (primary.withColumn("_p", F.lit(0)).unionByName(extras.withColumn("_p", F.lit(1)))
             .withColumn("attribute_key", attribute_key(F.col("attribute"))))
    open_drafts = every.join(decided, KEY, "left_anti")
    body = F.struct("_p", *[c for c in DRAFT if c not in KEY])
    return open_drafts.groupBy(*KEY).agg(F.min(body).alias("d")).select(
        *KEY, *[F.col(f"d.{c}").alias(c) for c in DRAFT if c not in KEY])


QUEUE_UPDATE = ["severity", "attribute", "current_value", "reason", "ai_value", "raw_value",
                "normalized_value", "allowed_values", "source", "evidence_text"]


def sync_queue(queue: DataFrame, drafts: DataFrame) -> DataFrame:
    """Merge drafts into the queue: closed rows stay, unwanted open rows go, matched open
    rows are updated, new keys are inserted as PENDING with an id derived from the key.
    """
    keyed = queue.withColumn("attribute_key", attribute_key(F.col("attribute")))
    closed = keyed.where(~F.col("status").isin(OPEN_REVIEW))
    open_rows = keyed.where(F.col("status").isin(OPEN_REVIEW))
    d = drafts.select(*KEY, F.lit(True).alias("_wanted"), *[F.col(c).alias(f"d_{c}") for c in QUEUE_UPDATE],
                      F.lit(True).alias("_d"))
    o = open_rows.withColumn("_o", F.lit(True))
    met = o.join(d, KEY, "full").where(F.col("_d"))
    carried = [c for c in queue.columns if c not in QUEUE_UPDATE + ["product_id", "issue_type", "review_id", "status"]]
    merged = met.select(
        F.coalesce("review_id", F.abs(F.xxhash64(*KEY))).alias("review_id"), "product_id", "issue_type",
        F.coalesce("status", F.lit("PENDING")).alias("status"),
        *[F.coalesce("d_ai_value", "d_current_value").alias(c) if c == "ai_value" else F.col(f"d_{c}").alias(c)
          for c in QUEUE_UPDATE if c in queue.columns], *carried)
    return closed.select(*queue.columns).unionByName(merged.select(*queue.columns))


def sync_candidates(stored: DataFrame, synced: DataFrame, fresh: DataFrame) -> DataFrame:
    """Candidate values in step with a synchronised queue: open reviews show those of their latest
    draft, closed ones keep what was decided on, and values of vanished reviews go."""
    keyed = stored.withColumn("attribute_key", attribute_key(F.col("attribute")))
    closed = synced.where(~F.col("status").isin(OPEN_REVIEW)).select(
        "product_id", "issue_type", attribute_key(F.col("attribute")).alias("attribute_key")).distinct()
    return keyed.join(closed, KEY, "left_semi").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def review_sources(queue: DataFrame, sources: DataFrame) -> DataFrame:
    """The product's sources beside each review, most authoritative first, one row per source.

    Sources are ranked once per product; a product with many reviews does not rank them again.
    """
    order = Window.partitionBy("product_id").orderBy(F.col("authority_score").desc_nulls_last(), "source_id", "url")
    ranked = sources.select("product_id", "source_id", "url", "title", "source_type", "authority_score").withColumn(
        "source_rank", F.row_number().over(order))
    return queue.select("review_id", "product_id").join(ranked, "product_id")


def open_counts(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status").isin(OPEN_REVIEW)).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("open_reviews"), F.min("review_id").alias("first_review_id"))


def quality_gate(products: DataFrame, queue: DataFrame) -> DataFrame:
    """Product status after synchronisation: any open row means REVIEW_REQUIRED."""
    df = products.join(open_counts(queue), "product_id", "left")
    waiting = F.coalesce("open_reviews", F.lit(0)) > 0
    return df.withColumn("status", F.when(waiting, "REVIEW_REQUIRED").otherwise(F.col("status"))).withColumn(
        "requires_review", waiting).withColumn("open_reviews", F.coalesce("open_reviews", F.lit(0)))


def normalize_decision(c):
    code = F.replace(F.upper(strip(c)), F.lit(" "), F.lit("_"))
    return F.coalesce(case_map(code, DECISION_ALIASES), code)


DECISIONS = ["APPROVE_CURRENT", "SELECT_CANDIDATE", "REJECT_ATTRIBUTE", "MARK_UNKNOWN"]


def apply_decisions(decisions: DataFrame, queue: DataFrame, attributes: DataFrame, candidates: DataFrame,
                    classpaths: DataFrame, vocab: Vocabulary | None) -> DataFrame:
    """Outcome of each decision, one row per review.

    decisions: review_id, decision, selected_value, selected_source, reviewed_by, review_reason.
    `problem` names a decision that cannot be applied; the other columns hold the new
    attribute row, the final value and the review's new status.
    """
    d = decisions.withColumn("decision", normalize_decision(F.col("decision")))
    q = queue.select("review_id", "product_id", "issue_type", F.col("attribute").alias("label"),
                     F.col("status").alias("queue_status"), F.col("current_value").alias("q_current"),
                     F.col("ai_value").alias("q_ai"))
    df = d.join(q, "review_id", "left").join(classpaths.select("product_id", "classpath"), "product_id", "left")
    ai = F.col("ai_value") if "ai_value" in attributes.columns else F.lit(None).cast("string")
    rows = attributes.select(
        "product_id", "label", F.lit(True).alias("has_row"), "raw_value", "normalized_value", "normalized_uom",
        "evidence_text", F.col("source_id").cast("long").alias("source_id"), "agreement", "normalization_method",
        F.col("selected_source").alias("row_source"), F.col("status").alias("row_status"), ai.alias("row_ai"))
    df = df.join(rows, ["product_id", "label"], "left")

    # Candidate choice in one aggregation per review.
    picks = df.where("decision = 'SELECT_CANDIDATE' and queue_status is not null").select(
        "review_id", "product_id", "label", "classpath", "selected_value", "selected_source")
    c = candidates.select("product_id", "label", F.col("ordinal").cast("long").alias("ordinal"),
                          F.col("value").alias("c_value"), F.col("source").alias("c_source"),
                          F.col("evidence_text").alias("c_evidence"), F.col("source_id").cast("long").alias("c_source_id"))
    pairs = picks.join(c.where(F.col("c_value").isNotNull()), ["product_id", "label"]).withColumn("_none", F.lit(None).cast("string"))
    pairs = normalize_values(pairs, vocab, "c_value", "_none", prefix="c_")
    pairs = normalize_values(pairs, vocab, "selected_value", "_none", prefix="s_")
    same = F.coalesce(F.lower(strip(F.col("c_value"))) == F.lower(strip(F.col("selected_value"))), F.lit(False)) | F.coalesce(
        comparison_key("c_") == comparison_key("s_"), F.lit(False))
    pairs = stage(pairs, {"_same": same, "_src": F.coalesce(F.upper("c_source") == F.upper("selected_source"), F.lit(False)),
                          "_cand": F.struct("ordinal", "c_value", "c_source", "c_evidence", "c_source_id")})
    by_source, by_value = F.nullif(F.col("selected_source"), F.lit("")), F.nullif(F.col("selected_value"), F.lit(""))
    chosen = pairs.groupBy("review_id", "selected_value", "selected_source").agg(
        F.min(F.when(F.col("_src") & F.col("_same"), F.col("_cand"))).alias("_both"),
        F.min(F.when(F.col("_src"), F.col("_cand"))).alias("_from"),
        F.count_if("_src").alias("_n"),
        F.min(F.when(F.col("_same"), F.col("_cand"))).alias("_value"),
    ).select("review_id", F.coalesce(
        F.when(by_source.isNotNull() & by_value.isNotNull(), F.col("_both")),
        F.when(by_source.isNotNull() & ((F.col("_n") == 1) | by_value.isNull()), F.col("_from")),
        F.when(by_value.isNotNull(), F.col("_value"))).alias("pick"))
    df = df.join(chosen, "review_id", "left")
    df = stage(df, {"_chosen": F.coalesce(F.nullif("pick.c_value", F.lit("")), F.nullif("selected_value", F.lit(""))),
                    "_none": F.lit(None).cast("string")})
    df = normalize_values(df, vocab, "_chosen", "_none", prefix="n_")

    is_sel, is_app = F.col("decision") == "SELECT_CANDIDATE", F.col("decision") == "APPROVE_CURRENT"
    has_row = F.coalesce("has_row", F.lit(False))
    problem = (
        F.when(F.col("queue_status").isNull(), "review not found")
        .when(~F.col("decision").isin(DECISIONS), "unknown decision")
        .when(~F.col("queue_status").isin(OPEN_REVIEW), F.concat(F.lit("review is already "), F.col("queue_status")))
        .when(is_sel & has_row & F.col("_chosen").isNull(), sentence("SELECTION_MISSING")))

    def filled(name):
        return F.nullif(F.col(name), F.lit(""))
    approved_value = F.coalesce(filled("normalized_value"), filled("raw_value"), F.col("q_current"))
    source = F.coalesce(by_source, filled("pick.c_source"), F.col("row_source"))
    conflict_done = is_app & (F.col("agreement") == "CONFLICT") & filled("normalized_value").isNotNull()

    def backed(src):
        return F.when(F.upper(src) == "MANUFACTURER", "MANUFACTURER_SUPPORTED").otherwise("INPUT_SOURCED")
    human = F.when(is_sel, F.coalesce("n_normalized_value", "_chosen")).when(is_app, approved_value)
    return df.select(
        "review_id", "product_id", "label", "decision", problem.alias("problem"), has_row.alias("has_row"),
        F.when(has_row, human).otherwise(F.col("selected_value")).alias("final_value"),
        F.coalesce(F.col("row_ai"), F.col("q_ai"), F.col("q_current"), F.col("raw_value"), F.col("normalized_value")).alias("ai_value"),
        human.alias("human_value"),
        F.when(is_sel, F.col("n_normalized_value")).when(is_app, F.col("normalized_value")).alias("normalized_value"),
        F.when(is_sel, F.coalesce("n_normalized_uom", "normalized_uom")).otherwise(F.col("normalized_uom")).alias("normalized_uom"),
        F.when(is_sel, source).when(is_app, F.col("row_source")).alias("attribute_source"),
        F.when(is_sel, backed(source)).when(conflict_done, backed(F.col("row_source")))
        .when(is_app, F.col("agreement")).otherwise("NOT_FOUND").alias("agreement"),
        F.when(is_sel | conflict_done, "NORMALIZED").when(is_app, F.col("row_status"))
        .when(F.col("decision") == "REJECT_ATTRIBUTE", "NOT_FOUND").otherwise("UNKNOWN").alias("attribute_status"),
        F.when(is_sel, F.concat_ws("+", filled("normalization_method"), F.lit("HUMAN"))).otherwise(
            F.col("normalization_method")).alias("normalization_method"),
        F.when(is_sel | is_app, "APPROVED").when(F.col("decision") == "MARK_UNKNOWN", "UNKNOWN").otherwise("REJECTED")
        .alias("queue_status"),
        F.coalesce("pick.c_evidence", "evidence_text").alias("evidence_text"),
        F.coalesce("pick.c_source_id", "source_id").alias("source_id"),
        "reviewed_by", "review_reason", by_source.alias("selected_source"),
    )


def updated_queue(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    good = outcomes.where("problem is null").select(
        "review_id", F.col("queue_status").alias("_s"), F.col("final_value").alias("_f"), F.col("decision").alias("_d"))
    df = queue.join(good, "review_id", "left")
    return df.select(*[F.coalesce("_s", "status").alias("status") if c == "status" else F.col(c) for c in queue.columns],
                     F.col("_f").alias("final_value"), F.col("_d").alias("decision"))


def updated_attributes(attributes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attribute rows with the decided ones rewritten."""
    changes = ["normalized_value", "normalized_uom", "agreement", "normalization_method", "evidence_text", "source_id"]
    good = outcomes.where("problem is null and has_row").select(
        "product_id", "label", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changes],
        F.col("attribute_source").alias("_selected_source"), F.col("attribute_status").alias("_status"),
        F.col("human_value").alias("_human"), F.col("ai_value").alias("_ai"), F.col("decision").alias("_decision"))
    df = attributes.join(good, ["product_id", "label"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    swap = set(changes) | {"selected_source", "status"}
    return df.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in swap else F.col(c)
                       for c in attributes.columns],
                     F.col("_human").alias("human_value"), F.col("_ai").alias("ai_value"),
                     F.col("_decision").alias("review_decision"))


def finalize_products(products: DataFrame, queue: DataFrame, validations: DataFrame) -> DataFrame:
    """Status after decisions: open reviews wait, an approvable validation approves."""
    df = products.join(open_counts(queue), "product_id", "left").join(
        validations.select("product_id", F.col("status").alias("v_status"), "approved_for_output"), "product_id", "left")
    status = (
        F.when(F.coalesce("open_reviews", F.lit(0)) > 0, "REVIEW_REQUIRED")
        .when(F.col("v_status").isNull() | F.col("approved_for_output"), "APPROVED")
        .otherwise(review_flow_status(F.col("v_status"))))
    return df.select("product_id", status.alias("status"), F.coalesce("open_reviews", F.lit(0)).alias("remaining_reviews"))


def process_summary(products: DataFrame, queue: DataFrame, validations: DataFrame) -> DataFrame:
    df = products.select("product_id", "status").join(open_counts(queue), "product_id", "left").join(
        validations.select("product_id", "approved_for_output"), "product_id", "left")
    waiting = F.coalesce("open_reviews", F.lit(0)) > 0
    return df.select(
        "product_id", F.when(waiting, "REVIEW_REQUIRED").otherwise(F.col("status")).alias("status"),
        (F.coalesce("approved_for_output", F.lit(False)) & ~waiting).alias("approved_for_output"),
        waiting.alias("requires_review"), F.col("first_review_id").alias("review_id"),
        F.coalesce("open_reviews", F.lit(0)).alias("open_reviews"))


def enrich_queue(queue: DataFrame, products: DataFrame, attributes: DataFrame, classifications: DataFrame,
                 vocab: Vocabulary | None = None) -> DataFrame:
    """Queue rows with all a reviewer needs: product, classification, the stored finding, and for
    vocabulary issues whose stored diagnostics are incomplete the attribute row and current list."""
    df = queue.join(products.select("product_id", "mpn", "description"), "product_id", "left").join(
        classifications.select("product_id", "classpath"), "product_id", "left")
    rows = attributes.select("product_id", F.col("label").alias("attribute"), F.col("raw_value").alias("a_raw"),
                             F.col("normalized_value").alias("a_norm"), F.col("selected_source").alias("a_source"),
                             F.col("evidence_text").alias("a_evidence"))
    # Only vocabulary issues look at the attribute table.
    lov = F.col("issue_type") == "LOV_INVALID"
    df = df.withColumn("_ak", F.when(lov, F.col("attribute"))).join(
        rows.withColumnRenamed("attribute", "_ak"), ["product_id", "_ak"], "left").drop("_ak")
    if vocab is not None:
        from ..scale import lookup
        product_type = attribute_key(F.col("attribute")) == "product type"
        lists = vocab.lists.select(F.col("label_key").alias("_lk"), F.col("classpath").alias("_lc"), "allowed")
        df = df.withColumn("_lk", F.when(product_type, "product type").otherwise(F.col("attribute"))).withColumn(
            "_lc", F.when(product_type, strip(F.coalesce("classpath", F.lit("")))).otherwise("")).join(
            lookup(lists), ["_lk", "_lc"], "left").drop("_lk", "_lc")
    else:
        df = df.withColumn("allowed", F.lit(None).cast("array<string>"))
    has = set(queue.columns)

    def stored(name):
        return F.nullif(F.col(name), F.lit("")) if name in has else F.lit(None).cast("string")
    listed = F.when(F.size("allowed_values") > 0, F.col("allowed_values")) if "allowed_values" in has else F.lit(None).cast("array<string>")
    df = df.withColumn("_listed", listed)
    # Findings that were stored whole are shown as they were.
    fill = lov & (F.col("_listed").isNull() | stored("normalized_value").isNull())

    def filled(name, current):
        return F.coalesce(stored(name), F.when(fill, F.col(current)))
    return df.select(
        "review_id", "product_id", "mpn", "issue_type", "attribute", "status", "classpath",
        *[stored(c).alias(c) for c in ("severity", "current_value", "reason")],
        filled("raw_value", "a_raw").alias("raw_value"),
        F.coalesce(filled("normalized_value", "a_norm"), stored("current_value")).alias("normalized_value"),
        F.coalesce("_listed", F.when(fill, F.col("allowed"))).alias("allowed_values"),
        filled("source", "a_source").alias("source"),
        filled("evidence_text", "a_evidence").alias("evidence_text"))


def queue_listing(queue: DataFrame, status: str | None = "PENDING", product_id: int | None = None) -> DataFrame:
    if status:
        queue = queue.where(F.col("status") == status)
    if product_id is not None:
        queue = queue.where(F.col("product_id") == product_id)
    return queue.orderBy("review_id")
