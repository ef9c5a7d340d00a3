"""Evidence memory: revisions and heads, recall by exact text or terms, availability, fixed-point activation, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from engramlake.functions.expressions import evidence_terms, normalised
from engramlake.operators import graph

MAX_RESULTS, MAX_TERMS, MAX_CANDIDATES, MAX_SCOPES, MAX_PINS = 100, 64, 4096, 32, 64
SCALE = 1_000_000
RECALLABLE = ("Evidence", "Claim", "Entity")
ASSISTANT = "AssistantUtterance"


def heads(revisions: DataFrame, *key: str) -> DataFrame:
    """The last revision of each record, columns as given."""
    key = key or ("record",)
    top = revisions.groupBy(*key).agg(F.max_by(F.struct(*revisions.columns), "revision").alias("r"))
    return top.select("r.*")


def inspect(revisions: DataFrame, payloads: DataFrame, record: str, revision: int | None = None) -> DataFrame:
    """A record's head, or an exact revision of its header with the payload of now; a purged one's payload is null."""
    mine = revisions.where(F.col("record") == record)
    got = heads(mine) if revision is None else mine.where(F.col("revision") == revision)
    purged = heads(mine).where("state = 'Purged'").select("record", F.lit(True).alias("_gone"))
    joined = got.join(payloads, "record", "left").join(purged, "record", "left")
    return joined.withColumn("payload", F.when(F.col("_gone").isNull(), F.col("payload"))).drop("_gone")


def observed(records: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """Newest first, observed in [start, end)."""
    return records.where((F.col("observed_at_ms") >= start) & (F.col("observed_at_ms") < end)).orderBy(F.desc("observed_at_ms"), "record").limit(limit)


def posting_scan(records: DataFrame, terms: list[str]) -> DataFrame:
    """record, term of those records that have a term."""
    t = records.select("record", F.explode(F.array_distinct(evidence_terms(F.col("text")))).alias("term"))
    return t.where(F.col("term").isin(*terms)) if terms else t.limit(0)


def recallable(records: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Active Evidence, Claims and Entities with a text, but no assistant's words, whose evidence is all Active.

    records: record, type, class, state, text; support: record, evidence.
    """
    r = records.where(F.col("type").isin(*RECALLABLE) & (F.col("state") == "Active") & F.col("text").isNotNull() & (F.coalesce("class", F.lit("")) != ASSISTANT))
    if support is None:
        return r
    active = records.where("state = 'Active'").select(F.col("record").alias("evidence"))
    broken = support.join(active, "evidence", "left_anti").select("record")
    return r.join(broken, "record", "left_anti")


def _inside(at: Column, start: Column, end: Column) -> Column:
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def recall(records: DataFrame, text: str = "", scopes: list[tuple[str, str]] | None = None, start: int | None = None, end: int | None = None, valid_at: int | None = None, limit: int = 10, support: DataFrame | None = None, without: str | None = None) -> DataFrame:
    """record, exact, terms, observed_at_ms, best first: exact text, then matched terms, then newest, then by record.

    A text matches by being the same when normalised, or by its terms, the MAX_TERMS first of them in order. Without a text,
    observed bounds give the candidates, the newest MAX_CANDIDATES. Bounds are half-open.
    """
    if limit > MAX_RESULTS or len(scopes or ()) > MAX_SCOPES:
        raise ValueError(f"at most {MAX_RESULTS} results and {MAX_SCOPES} scopes")
    r = recallable(records, support)
    if without is not None:
        r = r.where(F.col("record") != without)
    if scopes:
        r = r.where(F.struct("scope.kind", "scope.id").isin(*[F.struct(F.lit(k), F.lit(i)) for k, i in scopes]))
    if start is not None:
        r = r.where(F.col("observed_at_ms") >= start)
    if end is not None:
        r = r.where(F.col("observed_at_ms") < end)
    if valid_at is not None:
        r = r.where(_inside(F.lit(valid_at), F.col("valid_from_ms"), F.col("valid_to_ms")))
    if not text.strip():
        found = r.select("record", F.lit(False).alias("exact"), F.lit(0).cast("bigint").alias("terms"), "observed_at_ms")
        if start is None and end is None:
            found = found.limit(0)
        else:
            found = found.orderBy(F.desc("observed_at_ms"), "record").limit(MAX_CANDIDATES)
    else:
        wanted = sorted(x[0] for x in records.sparkSession.range(1).select(F.explode(F.array_distinct(evidence_terms(F.lit(text))))).collect())[:MAX_TERMS]
        exact = normalised(F.col("text")) == normalised(F.lit(text))
        count = F.size(F.array_intersect(evidence_terms(F.col("text")), F.array(*[F.lit(t) for t in wanted]))) if wanted else F.lit(0)
        found = r.select("record", exact.alias("exact"), count.cast("bigint").alias("terms"), "observed_at_ms").where("exact or terms > 0")
    return found.orderBy(F.desc("exact"), F.desc("terms"), F.desc("observed_at_ms"), "record").limit(limit)


def turn_recall(records: DataFrame, captured: str, text: str, **how) -> DataFrame:
    """Recall for a turn just captured, which isn't its own result."""
    return recall(records, text, without=captured, **how)


def profile_availability(profiles: DataFrame, evaluators: DataFrame) -> DataFrame:
    """profile_id, reason, from heads: inactive, missing evaluator, stale evaluator, else available.

    profiles: profile_id, state, evaluator_id, evaluator_revision; evaluators: evaluator_id, revision, state.
    """
    e = evaluators.select("evaluator_id", F.col("revision").alias("_now"), F.col("state").alias("_state"))
    why = (
        F.when(F.col("state") != "Active", "ProfileInactive").when(F.col("_now").isNull(), "EvaluatorMissing")
        .when((F.col("_state") != "Active") | (F.col("_now") != F.col("evaluator_revision")), "EvaluatorStale").otherwise("Available")
    )
    return profiles.join(e, "evaluator_id", "left").select("profile_id", why.alias("reason"))


def signal_availability(signals: DataFrame, payloads: DataFrame, profiles: DataFrame, evaluators: DataFrame, records: DataFrame) -> DataFrame:
    """signal_id, reason: the first of purged, missing payload, evaluator, profile, sources that holds, else available.

    signals: signal_id, state, profile_id, profile_revision, from_record, to_record; payloads: signal_id;
    profiles: profile_id, revision and what profile_availability reads; records: record, state.
    """
    of = profile_availability(profiles, evaluators).join(profiles.select("profile_id", F.col("revision").alias("_rev")), "profile_id")
    has = payloads.select("signal_id", F.lit(True).alias("_has")).distinct()
    live = records.where("state = 'Active'").select("record")
    s = signals.join(has, "signal_id", "left").join(of.withColumnRenamed("reason", "_profile"), "profile_id", "left")
    s = s.join(live.select(F.col("record").alias("from_record"), F.lit(True).alias("_a")), "from_record", "left")
    s = s.join(live.select(F.col("record").alias("to_record"), F.lit(True).alias("_b")), "to_record", "left")
    why = (
        F.when(F.col("state") == "Purged", "Purged").when(F.col("_has").isNull(), "PayloadMissing")
        .when(F.col("_profile").isin("EvaluatorMissing", "EvaluatorStale"), F.col("_profile"))
        .when(F.col("_profile").isNull(), "ProfileMissing").when(F.col("_profile") != "Available", F.col("_profile"))
        .when(F.col("_rev") != F.col("profile_revision"), "ProfileStale")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "SourceInactive").otherwise("Available")
    )
    return s.select("signal_id", why.alias("reason"))


def activate(pins: DataFrame, signals: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributions (from_record, to_record, micros) and totals (record, baseline, total, shadow_rank) among pinned records.

    pins: record, baseline (rank in the recall), at most MAX_PINS; signals, those available: from_record, to_record,
    dimension, score_micros; weights: dimension, weight_micros. A pair's contribution is the sum of score times weight,
    divided by SCALE towards zero; overflow of 64 bits is an error. Ranks go from 0: total descending, baseline, record.
    """
    if pins.limit(MAX_PINS + 1).count() > MAX_PINS:
        raise ValueError(f"at most {MAX_PINS} records are pinned")
    named = pins.select("record")
    s = signals.join(F.broadcast(named.withColumnRenamed("record", "from_record")), "from_record", "left_semi")
    s = s.join(F.broadcast(named.withColumnRenamed("record", "to_record")), "to_record", "left_semi").where("from_record <> to_record")
    s = s.join(F.broadcast(weights.select("dimension", F.col("weight_micros").cast("bigint"))), "dimension")
    product = (F.col("score_micros").cast("bigint") * F.col("weight_micros")).cast("decimal(38,0)")
    raw = s.groupBy("from_record", "to_record").agg(F.sum(product).cast("bigint").alias("raw"))
    parts = raw.select("from_record", "to_record", F.expr(f"raw div {SCALE}").alias("micros"))
    sums = parts.groupBy("to_record").agg(F.sum("micros").alias("total"))
    totals = pins.join(sums, F.col("record") == F.col("to_record"), "left").select("record", "baseline", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))
    w = Window.orderBy(F.desc("total"), "baseline", "record")
    return parts, totals.withColumn("shadow_rank", (F.row_number().over(w) - 1).cast("bigint"))


def purge_preview(root: DataFrame, dependencies: DataFrame, records: DataFrame, payloads: DataFrame, signals: DataFrame, traces: DataFrame) -> DataFrame:
    """records, payloads, signals, traces: how many a purge of root (record) would touch, itself and all that depends on it."""
    touched = graph.cut(root.select("record").unionByName(graph.closure(root, dependencies, records, active_only=False)).distinct())
    live = touched.join(payloads.select("record").distinct(), "record", "left_semi")
    by = signals.join(touched.withColumnRenamed("record", "from_record"), "from_record", "left_semi").select("signal_id")
    to = signals.join(touched.withColumnRenamed("record", "to_record"), "to_record", "left_semi").select("signal_id")
    seen = traces.join(touched, "record", "left_semi").select("trace_id").distinct()
    n = lambda d, c: d.agg(F.count("*").alias(c))
    return n(touched, "records").crossJoin(n(live, "payloads")).crossJoin(n(by.unionByName(to).distinct(), "signals")).crossJoin(n(seen, "traces"))


def purge(revisions: DataFrame, touched: DataFrame, now_ms: int) -> DataFrame:
    """The revisions to append: a Purged one for each record touched."""
    h = heads(revisions).join(touched.select("record"), "record", "left_semi")
    changed = {"revision": F.col("revision") + 1, "state": F.lit("Purged")}
    if "recorded_at_ms" in revisions.columns:
        changed["recorded_at_ms"] = F.lit(now_ms)
    return h.withColumns(changed).select(*revisions.columns)


# Who may do what: small fixed tables, looked up for one request or joined as columns.

_BY_HAND = ("System", "Operator")
#: Actors that may capture a class of evidence; artifacts come through imports alone.
CAPTURE = {
    "UserAssertion": ("User",),
    "UserCorrection": ("User",),
    "ImportedSource": ("User", *_BY_HAND),
    "ToolObservation": _BY_HAND,
    "ActionOutcome": _BY_HAND,
    "SystemObservation": _BY_HAND,
    "AssistantCommitment": _BY_HAND,
    "AssistantUtterance": ("Assistant", *_BY_HAND),
}
USER_CLASSES = ("UserAssertion", "UserCorrection")
USER_DOMAINS = ("UserProfile", "UserPreference", "UserNote", "SessionContext")
_SEEN = ("ExternalFact", "WorkspaceFact", "SessionContext", "SystemFact")
_ARTIFACT = ("ArtifactContent", "ExternalFact", "WorkspaceFact")
#: Domains of claims that a class of evidence can support.
SUPPORTS = {
    "UserAssertion": USER_DOMAINS,
    "UserCorrection": (*USER_DOMAINS, "ExternalFact", "WorkspaceFact"),
    "ImportedSource": _ARTIFACT,
    "ToolObservation": _SEEN,
    "ActionOutcome": _SEEN,
    "SystemObservation": ("SessionContext", "SystemFact"),
    "AssistantCommitment": ("AssistantCommitment",),
    "AssistantUtterance": (),
    "ArtifactSnapshot": _ARTIFACT,
    "ArtifactPassage": _ARTIFACT,
}
_THINGS = ("Evidence", "Claim", "Entity")
#: Kinds of records that a relation may lead from and to.
ENDPOINTS = {
    "Supports": {(a, "Claim") for a in ("Evidence", "Claim")},
    "Contradicts": {(a, "Claim") for a in ("Evidence", "Claim")},
    "Supersedes": {("Claim", "Claim"), ("Entity", "Entity")},
    "About": {(a, b) for a in _THINGS for b in _THINGS if (a == "Entity") != (b == "Entity")},
    "RefersTo": {(a, "Entity") for a in _THINGS},
    "DerivedFrom": {(a, b) for a in ("Claim", "Entity") for b in _THINGS},
    "CanonicalizesTo": {("Entity", "Entity")},
}


def check_capture(actor: str, evidence_class: str, terminal: str | None = None) -> None:
    """Raises where an actor may not capture a class of evidence; terminal: the status of the turn that it ends, if any."""
    if evidence_class not in CAPTURE:
        raise ValueError("artifacts are captured by imports")
    if actor not in CAPTURE[evidence_class]:
        raise PermissionError(f"{actor} can't capture {evidence_class}")
    if evidence_class == "AssistantCommitment":
        fits = terminal == "Completed"
    else:
        fits = terminal is None or evidence_class in ("ToolObservation", "ActionOutcome", "AssistantUtterance")
    if not fits:
        raise ValueError(f"{evidence_class} doesn't go with this lifecycle")


def check_relation(actor: str, kind: str, source: tuple[str, str], target: tuple[str, str], classes: list[str]) -> None:
    """Raises where a relation isn't admissible; source and target: (kind, id); classes: of its evidence."""
    if source == target or (source[0], target[0]) not in ENDPOINTS.get(kind, ()):
        raise ValueError(f"{kind} can't lead from {source} to {target}")
    if actor == "Assistant" or actor == "User" and not set(classes) <= set(USER_CLASSES):
        raise PermissionError("this actor can't relate by this evidence")


def check_adjudication(actor: str, authority: str) -> None:
    if (actor, authority) not in (("User", "ExplicitUser"), ("Operator", "ExplicitOperator")):
        raise PermissionError("a proposal is adjudicated by the user or the operator")


def check_claim(actor: str, domain: str, scope: tuple, sources: list[dict]) -> None:
    """Raises where a claim isn't admissible; sources: class, state, scope of each."""
    if actor == "Assistant":
        raise PermissionError("an assistant can't create claims")
    if not 1 <= len(sources) <= 64:
        raise ValueError("a claim has 1 to 64 sources")
    if any(s["state"] != "Active" or tuple(s["scope"]) != tuple(scope) for s in sources):
        raise ValueError("a claim's sources are active and in its scope")
    if any(domain not in SUPPORTS[s["class"]] for s in sources):
        raise ValueError(f"a source can't support {domain}")
    if actor == "User" and (domain not in USER_DOMAINS or any(s["class"] not in USER_CLASSES for s in sources)):
        raise PermissionError("users claim in their own domains, by their own evidence")


def check_signals(signals: list[dict], dimensions: set[str]) -> None:
    """Raises where a batch of signals isn't admissible: from, to, scores ({dimension: micros})."""
    pairs = [(s["from"], s["to"]) for s in signals]
    if len(signals) > 1024 or len(set(pairs)) != len(pairs) or any(a == b for a, b in pairs):
        raise ValueError("a batch has at most 1024 signals, of different pairs of different records")
    for s in signals:
        if not 1 <= len(s["scores"]) <= 16 or not set(s["scores"]) <= dimensions or any(abs(v) > SCALE for v in s["scores"].values()):
            raise ValueError("a signal has 1 to 16 scores of the profile's dimensions, none above 1e6")
