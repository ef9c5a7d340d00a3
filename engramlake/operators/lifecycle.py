"""What happens to nodes over time: ingest, retraction, access, state, audit, blobs, consolidation, proposals.

Tables are append-only revisions under one writer: an operation reads heads, checks, and returns the rows to append.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from engramlake.functions.expressions import json_strings

INLINE_BYTES = 64 * 1024
SENSITIVE = (
    "api_key", "apikey", "access_key", "authorization", "blob_bytes", "bytes", "credential", "credentials",
    "endpoint", "inline", "password", "secret", "token", "vector", "vectors",
)
_TELLING = ("api_key", "apikey", "authorization", "credential", "endpoint", "password", "secret", "token")


class Conflict(Exception):
    """What was expected of a head doesn't hold."""


# Nodes


def scan_by_time(nodes: DataFrame, start: int, end: int, limit: int | None = None, tenant: int = 0) -> DataFrame:
    """Oldest first, created in [start, end); times before 0 sort after all others and are never in a scan."""
    at = F.col("created_at_ms")
    out = nodes.where((F.col("tenant") == tenant) & (at >= max(0, start)) & (at < end)).orderBy("created_at_ms", "node_id")
    return out if limit is None else out.limit(limit)


def get(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def meta(nodes: DataFrame) -> DataFrame:
    """Headers alone, so that no other column is read."""
    return nodes.select("node_id", "kind", "created_at_ms", "updated_at_ms")


def by_metadata(nodes: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Nodes whose metadata has all these values (JSON text), of any state, by time and id."""
    for key, js in conditions.items():
        nodes = nodes.where(F.element_at("metadata", F.lit(key)) == js)
    return nodes.orderBy("created_at_ms", "node_id")


def current(nodes: DataFrame) -> DataFrame:
    """The last revision of each node, without deleted ones."""
    w = Window.partitionBy("tenant", "node_id").orderBy(F.desc("revision"))
    return nodes.withColumn("_r", F.row_number().over(w)).where("_r = 1 and state <> 'Deleted'").drop("_r")


def insert(existing: DataFrame, new: DataFrame, tenant: int, now_ms: int) -> DataFrame:
    """The revisions to append for new nodes: the tenant stamped, revision one beyond the last, valid_from by default now."""
    last = existing.groupBy("node_id").agg(F.max("revision").alias("_last"))
    own = F.coalesce(F.col("revision"), F.lit(0))
    return (
        new.join(last, "node_id", "left")
        .withColumns({
            "tenant": F.lit(tenant).cast("bigint"), "revision": F.greatest(F.coalesce("_last", F.lit(0)), own) + 1,
            "updated_at_ms": F.lit(now_ms).cast("bigint"), "created_at_ms": F.coalesce("created_at_ms", F.lit(now_ms).cast("bigint")),
            "state": F.coalesce("state", F.lit("Active")), "valid_from_ms": F.coalesce("valid_from_ms", "created_at_ms", F.lit(now_ms).cast("bigint")),
        }).select(*existing.columns)
    )


def retract(nodes: DataFrame, node_id: str, now_ms: int, expected_revision: int | None = None) -> DataFrame:
    """The revision that retracts a node: validity ends now or where it already did; a pending one's is empty."""
    head = current(nodes).where(F.col("node_id") == node_id)
    row = head.select("revision").first()
    if row is None or expected_revision is not None and row["revision"] != expected_revision:
        raise Conflict(f"{node_id} isn't at revision {expected_revision}")
    start = F.coalesce("valid_from_ms", "created_at_ms")
    end = F.when(F.col("state") == "Pending", start).otherwise(F.least(F.coalesce("valid_to_ms", F.lit(now_ms)), F.lit(now_ms)))
    return head.withColumns({"valid_to_ms": end.cast("bigint"), "state": F.lit("Retracted"), "revision": F.col("revision") + 1, "updated_at_ms": F.lit(now_ms).cast("bigint")})


def delete(table: DataFrame, ids: DataFrame, key: str = "node_id") -> DataFrame:
    """A table without some ids, to be written in its place."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def statistics(nodes: DataFrame) -> DataFrame:
    """tenant, kind, n."""
    return nodes.groupBy("tenant", "kind").agg(F.count("*").alias("n"))


# Access counters


def record_access(events: DataFrame) -> DataFrame:
    """node_id, access_count, last_accessed from events (node_id, at_ms)."""
    return events.groupBy("node_id").agg(F.count("*").alias("access_count"), F.max("at_ms").alias("last_accessed"))


def merge_access(access: DataFrame, merges: DataFrame) -> DataFrame:
    """Counters after merging source into target (both in merges): sums, latest times; sources are gone."""
    into = access.join(merges, F.col("node_id") == F.col("source"), "left").withColumn("node_id", F.coalesce("target", "node_id"))
    return into.groupBy("node_id").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"))


# Application state: key, json, revision, deleted


def state_heads(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.max_by(F.struct(*state.columns), "revision").alias("h")).select("h.*")


def state_get(state: DataFrame, key: str) -> DataFrame:
    return state_heads(state.where(F.col("key") == key)).where("not deleted")


def state_scan(state: DataFrame, prefix: str = "", after: str | None = None, limit: int | None = None) -> DataFrame:
    """Live entries of a prefix, by key, those after a cursor; deleted ones don't count."""
    s = state.where(F.col("key").startswith(prefix))
    if after is not None:
        s = s.where(F.col("key") > after)
    out = state_heads(s).where("not deleted").orderBy("key")
    return out if limit is None else out.limit(limit)


def state_apply(state: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Rows to append for changes (key, json or null to delete, expected or null): all, or Conflict for all.

    expected is the head's revision, 0 for a key that was never there; null isn't checked. A deletion keeps a tombstone.
    """
    h = state_heads(state).select("key", F.col("revision").alias("_rev"))
    c = changes.join(h, "key", "left").withColumn("_rev", F.coalesce("_rev", F.lit(0).cast("bigint")))
    bad = c.where("expected is not null and expected <> _rev").limit(1).collect()
    if bad:
        raise Conflict(f"{bad[0]['key']} is at revision {bad[0]['_rev']}")
    return c.select("key", "json", (F.col("_rev") + 1).alias("revision"), F.col("json").isNull().alias("deleted"), F.lit(now_ms).cast("bigint").alias("updated_at_ms"))


def state_replace_prefix(state: DataFrame, prefix: str, new: DataFrame, now_ms: int) -> DataFrame:
    """Rows to append so that a prefix has just the new entries (key, json)."""
    live = state_scan(state, prefix).select("key", F.lit(None).cast("string").alias("json"))
    gone = live.join(new.select("key"), "key", "left_anti")
    every = new.select("key", "json").unionByName(gone).withColumn("expected", F.lit(None).cast("bigint"))
    return state_apply(state, every, now_ms)


# Audit


def audit_scan(audit: DataFrame, operation: str | None = None, action: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None, oldest: bool = False) -> DataFrame:
    """Records in order, both bounds inclusive; a limit keeps the newest, or with oldest the first."""
    a = audit
    for c in ([F.col("operation_id") == operation] if operation else []) + ([F.col("action") == action] if action else []) + ([F.col("at_ms") >= start] if start is not None else []) + ([F.col("at_ms") <= end] if end is not None else []):
        a = a.where(c)
    if limit is not None:
        a = a.orderBy(F.asc("audit_id") if oldest else F.desc("audit_id")).limit(limit)
    return a.orderBy("audit_id")


def sanitised(value):
    """A JSON value without the keys that may hold secrets, at any depth."""
    if isinstance(value, list):
        return [sanitised(v) for v in value]
    if isinstance(value, dict):
        return {k: sanitised(v) for k, v in value.items() if k.lower() not in SENSITIVE}
    return value


def sanitise_json(c: Column) -> Column:
    @pandas_udf("string")
    def run(s):
        return s.map(lambda t: None if t is None else json.dumps(sanitised(json.loads(t)), separators=(",", ":"), ensure_ascii=False))

    return run(c)


def sanitise_error(c: Column) -> Column:
    """Words that tell of secrets or addresses, and the one after `bearer`, as [redacted]; white space collapsed."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    # A word is redacted after a `bearer` that isn't itself redacted: of a row of them, every other one is.
    step = lambda acc, w: F.struct(
        F.array_append(acc["out"], F.when(acc["next"], F.lit("[redacted]")).when(F.lower(w) == "bearer", F.lit("Bearer")).when(F.lower(w).rlike("|".join(map(re.escape, _TELLING)) + "|^https?://"), F.lit("[redacted]")).otherwise(w)).alias("out"),
        (~acc["next"] & (F.lower(w) == "bearer")).alias("next"),
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("next"))
    return F.array_join(F.aggregate(words, start, step, lambda acc: acc["out"]), " ")


# Blobs. Content is addressed by SHA-256.


def put_blobs(files: DataFrame) -> DataFrame:
    """hash, size, refcount, chunked, inline: files (content binary) once each; what is small is held inline."""
    h = files.select(F.sha2("content", 256).alias("hash"), "content", F.length("content").cast("bigint").alias("size"))
    one = h.groupBy("hash", "size").agg(F.count("*").alias("refcount"), F.first("content").alias("content"))
    large = F.col("size") > INLINE_BYTES
    return one.select("hash", "size", "refcount", large.alias("chunked"), F.when(~large, F.col("content")).alias("inline"))


def refcounts(blobs: DataFrame, changes: DataFrame) -> DataFrame:
    """blobs with refcounts after changes (hash, delta), none below 0."""
    d = changes.groupBy("hash").agg(F.sum("delta").alias("_d"))
    return blobs.join(d, "hash", "left").withColumn("refcount", F.greatest(F.lit(0), F.col("refcount") + F.coalesce("_d", F.lit(0)))).drop("_d")


def collectable(blobs: DataFrame) -> DataFrame:
    return blobs.where("refcount = 0").select("hash")


def orphans(listing: DataFrame, blobs: DataFrame) -> DataFrame:
    """Stored hashes without metadata."""
    return listing.select("hash").join(blobs.select("hash"), "hash", "left_anti")


# Consolidation: an agent reads sources and writes nodes that cite them


def consolidation_sources(nodes: DataFrame, processed: DataFrame, max_nodes: int = 128, max_bytes: int = 256 * 1024, size: Column | None = None) -> DataFrame:
    """node_id, size, place of what an agent is to read next: nothing unless some source is new.

    Active episodes and facts, new ones first and then outputs of earlier runs (metadata 'consolidation_run'), each in time
    order; the longest head of at most max_nodes and max_bytes. Only that many rows are brought together.
    """
    size = F.octet_length(F.coalesce("content.text", "content.json", F.lit(""))) if size is None else size
    made = F.coalesce(F.map_contains_key("metadata", "consolidation_run"), F.lit(False))
    n = nodes.where("state = 'Active' and kind in ('Episode', 'Fact')").select("node_id", "created_at_ms", size.cast("bigint").alias("size"), made.cast("int").alias("group"))
    fresh = n.where("group = 0").join(processed.select("node_id"), "node_id", "left_anti")
    every = fresh.unionByName(n.where("group = 1").crossJoin(F.broadcast(fresh.limit(1).select(F.lit(1).alias("_any")))).drop("_any"))
    limit = min(max_nodes, 128)
    head = every.orderBy("group", "created_at_ms", "node_id").limit(limit)
    w = Window.orderBy("group", "created_at_ms", "node_id")
    run = head.withColumns({"place": F.row_number().over(w), "_sum": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return run.where(F.col("_sum") <= min(max_bytes, 256 * 1024)).select("node_id", "size", "place")


@dataclass
class Run:
    """A consolidation run: Pending, Completing, Completed; or Reverting, Reverted, Repaired, Failed."""

    run_id: str
    sources: tuple[str, ...]
    status: str = "Pending"
    outputs: tuple[dict, ...] = ()


def consolidate(run: Run, read: Callable[[], list[dict]], agent: Callable[[list[dict]], list[dict]]) -> Run:
    """The agent's outputs ({kind, text, cites}), each of which cites sources of the run; staged as Pending nodes.

    A run's outputs carry its id and their citations as metadata, and a derived_from edge of weight 1 to each source.
    """
    outputs = agent(read())
    for o in outputs:
        if not o.get("cites") or not set(o["cites"]) <= set(run.sources):
            raise ValueError("an output cites sources of its run")
    staged = tuple({**o, "state": "Pending", "metadata": {"consolidation_run": json.dumps(run.run_id), "source_citations": json.dumps(sorted(o["cites"]))}, "edges": [(c, "derived_from", 1.0) for c in sorted(set(o["cites"]))]} for o in outputs)
    return Run(run.run_id, run.sources, "Completing", staged)


def complete(run: Run, revisions: dict[str, int], expected: dict[str, int]) -> Run:
    """Outputs become Active, if no source has changed since."""
    if run.status != "Completing":
        raise Conflict(f"a run is completed from Completing, not {run.status}")
    if any(revisions.get(s) != expected.get(s) for s in run.sources):
        raise Conflict("a source has changed")
    return Run(run.run_id, run.sources, "Completed", tuple({**o, "state": "Active"} for o in run.outputs))


def revert(run: Run, edited: frozenset[str] = frozenset()) -> tuple[Run, tuple[dict, ...]]:
    """The run as Reverted, and the outputs kept since someone edited them; others are retracted."""
    if run.status not in ("Completed", "Reverting"):
        raise Conflict(f"a run is reverted from Completed, not {run.status}")
    kept = tuple(o for o in run.outputs if o.get("node_id") in edited)
    return Run(run.run_id, run.sources, "Reverted", tuple({**o, "state": "Retracted"} for o in run.outputs if o not in kept)), kept


def repair(run: Run) -> Run:
    """What a run that was cut off becomes when the store is opened again."""
    return Run(run.run_id, run.sources, {"Pending": "Repaired", "Completing": "Repaired", "Reverting": "Reverted"}.get(run.status, run.status), ())


def due(turns_since: int, threshold: int = 32) -> bool:
    return turns_since >= threshold


# Proposals


VERDICTS = {"Approve": "ReviewedApprove", "Reject": "ReviewedReject", "NeedsUser": "NeedsUser", "Unsupported": "Unsupported"}
MAX_PINS, MAX_CHANGES = 64, 128


@dataclass
class Proposal:
    """Changes under evidence: pins are {record: revision}; changes name a target and what they cite."""

    proposal_id: str
    pins: dict[str, int]
    changes: tuple[dict, ...]
    status: str = "Pending"
    findings: tuple[dict, ...] = field(default=())

    def check(self) -> Proposal:
        cited = {c for x in self.changes for c in x.get("cites", ())}
        targets = [x["target"] for x in self.changes if x.get("target")]
        drafts = [x["draft"] for x in self.changes if x.get("draft")]
        if not 1 <= len(self.pins) <= MAX_PINS or not 1 <= len(self.changes) <= MAX_CHANGES:
            raise ValueError(f"a proposal has 1 to {MAX_PINS} pins and 1 to {MAX_CHANGES} changes")
        if not cited <= set(self.pins) or len(set(targets)) != len(targets) or len(set(drafts)) != len(drafts) or set(targets) & cited:
            raise ValueError("what is cited is pinned, and no target is changed twice or cited as its own evidence")
        return self

    def reviewed(self, verdict: str, findings: tuple[dict, ...] = ()) -> Proposal:
        if self.status != "Pending":
            raise Conflict(f"a proposal is reviewed once, not when {self.status}")
        if verdict == "Approve" and findings or any(f["pin"] not in self.pins for f in findings):
            raise ValueError("findings name pins, and an approval has none")
        return Proposal(self.proposal_id, self.pins, self.changes, VERDICTS[verdict], findings)

    def adjudicated(self, accept: bool, heads: dict[str, tuple[int, str]]) -> Proposal:
        """Applied, Rejected, or Stale where a pin (record: revision, state in heads) isn't as it was."""
        if self.status not in ("ReviewedApprove", "NeedsUser"):
            raise Conflict(f"a proposal isn't adjudicated when {self.status}")
        if not accept:
            return Proposal(self.proposal_id, self.pins, self.changes, "Rejected", self.findings)
        fresh = all(heads.get(r) == (v, "Active") for r, v in self.pins.items())
        return Proposal(self.proposal_id, self.pins, self.changes, "Applied" if fresh else "Stale", self.findings)


def proposal_list(proposals: DataFrame, statuses: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Newest id first, at most 100."""
    p = proposals.where(F.col("status").isin(*statuses)) if statuses else proposals
    return p.orderBy(F.desc("proposal_id")).limit(min(limit, 100))


def replayed(operations: DataFrame, operation_id: str, digest: str) -> str | None:
    """The receipt of an operation done before, None of a new one; Conflict where it was another."""
    row = operations.where(F.col("operation_id") == operation_id).select("digest", "receipt").first()
    if row is not None and row["digest"] != digest:
        raise Conflict(f"operation {operation_id} was another")
    return None if row is None else row["receipt"]


def searchable(text: Column) -> Column:
    """All strings and keys of structured content, a line each."""

    @pandas_udf("string")
    def run(s):
        return s.map(lambda t: "\n".join(json_strings(t)))

    return run(text)
