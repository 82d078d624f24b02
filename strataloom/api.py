"""The engine's requests as plain functions on a catalog, and the commands that call them."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalars import metered_tokens, route
from strataloom.operators import lineage, migration, search
from strataloom.operators.catalog import Catalog
from strataloom.session import cut_lineage


ALIAS = "active"
DEFAULTS = {"active_collection": None, "shadow_collection": None, "traffic_split_ratio": 1.0, "shadow_read_enabled": False, "active_model": None, "active_version": None}


class Service:
    """Searches, lineage, staleness, routing and metrics over one catalog and its vector store (item_id, collection_name, vector).

    The policy lies in the catalog, so it outlives the process; the collection that answers is the one that the catalog's
    alias stands for, or the policy's if there is no alias."""

    def __init__(self, catalog: Catalog, store: DataFrame | None = None, embed=None, policy: dict | None = None, shadow_embed=None):
        self.catalog, self.store, self.embed, self.shadow_embed = catalog, store, embed, shadow_embed or embed
        self._given = policy or {}
        self._metrics: list[tuple[str, dict, float]] = []

    @property
    def policy(self) -> dict:
        held = DEFAULTS | self._given | self.catalog.policy()
        return held | ({"active_collection": self.catalog.alias(ALIAS)} if self.catalog.alias(ALIAS) else {})

    def health(self) -> dict:
        return {"status": "ok"}

    def _hits(self, name: str, embed, query: str, top_k: int) -> tuple[list[dict], float]:
        """A collection's best items with a score of at least 0, and the seconds it took."""
        start = time.perf_counter()
        vector = [float(x) for x in embed([query])[0]]
        corpus = self.store.filter(F.col("collection_name") == name)
        asked = self.catalog.spark.createDataFrame([(0, vector)], "query_id int, vector array<double>")
        found = [{"id": r.item_id, "score": r.score} for r in search.top_k(corpus, asked, top_k, least=0.0).orderBy("rank").collect()]
        return found, time.perf_counter() - start

    def search(self, query: str, top_k: int = 10) -> list[dict]:
        """The best items of the collection that the query is routed to, with a score of at least 0.

        With shadow reads on, a query that goes live also asks the shadow collection; what that finds is only measured:
        items in common and the difference of the latencies, or its error, which does not reach the caller."""
        policy = self.policy
        asked = self.catalog.spark.createDataFrame([(query,)], "query string")
        where = asked.select(route(F.col("query"), float(policy["traffic_split_ratio"]), bool(policy["shadow_collection"])).alias("r"), metered_tokens(F.col("query")).alias("n")).first()
        live = where.r == "live"
        hits, seconds = self._hits(policy["active_collection"] if live else policy["shadow_collection"], self.embed if live else self.shadow_embed, query, top_k)
        self._metrics.append(("embedding_tokens_total", {"model_name": str(policy["active_model"])}, float(where.n)))
        self._metrics.append(("search_requests_total", {"route": where.r}, 1.0))
        if live and policy["shadow_read_enabled"] and policy["shadow_collection"]:
            try:
                others, other_seconds = self._hits(policy["shadow_collection"], self.shadow_embed, query, top_k)
                self._metrics.append(("shadow_reads_total", {}, 1.0))
                self._metrics.append(("shadow_shared_items_total", {}, float(len({h["id"] for h in hits} & {h["id"] for h in others}))))
                self._metrics.append(("shadow_latency_delta_seconds_sum", {}, other_seconds - seconds))
            except Exception:  # noqa: BLE001  a shadow's fault must not break the live answer
                self._metrics.append(("shadow_errors_total", {}, 1.0))
        return hits

    def lineage(self, vector_id: str) -> dict:
        t = self.catalog.table
        return lineage.vector_provenance(lineage.backward(t("vectors"), t("chunks"), t("documents"), t("embedding_models")), vector_id)

    def staleness(self) -> dict:
        t = self.catalog.table
        rows = lineage.stale_breakdown(t("vectors"), t("chunks"), self.policy["active_model"] or "", self.policy["active_version"] or "", t("chunk_strategies")).collect()
        stale, total = sum(r.stale for r in rows), sum(r.total for r in rows)
        return {"stale": stale, "total": total, "stale_percent": 100.0 * stale / total if total else 0.0, "by_model_version": {r.model_version: r.stale for r in rows}}

    def routing(self, **changes) -> dict:
        """Merges the changes that are not null into the stored policy."""
        if unknown := [k for k in changes if k not in DEFAULTS]:
            raise ValueError(f"no such settings: {unknown}")
        self.catalog.set_policy(**changes)
        return self.policy

    def metrics(self) -> str:
        from strataloom.operators.telemetry import exposition

        if not self._metrics:
            return ""
        df = self.catalog.spark.createDataFrame(self._metrics, "name string, labels map<string,string>, value double").groupBy("name", F.to_json("labels").alias("l")).agg(F.sum("value").alias("value"))
        return "\n".join(r.line for r in exposition(df.select("name", F.from_json("l", "map<string,string>").alias("labels"), "value")).orderBy("line").collect())

    def status(self) -> dict:
        t = self.catalog.tables()
        return {n: df.count() for n, df in t.items()} | {"policy": self.policy}

    def cutover(self, off: str, on: str) -> None:
        """Makes `on` the active collection: flags, alias and policy change together, or not at all if `on` has no vectors."""
        if self.catalog.table("vectors").filter(F.col("collection_name") == on).isEmpty():
            raise ValueError(f"{on} has no vectors")
        with self.catalog.transaction():
            self.catalog.replace("vectors", migration.switch_active(self.catalog.table("vectors"), off, on))
            self.catalog.set_alias(ALIAS, on)
            self.catalog.set_policy(active_collection=on, previous_collection=off)

    def rollback(self) -> dict:
        """Undoes the last cutover."""
        policy = self.catalog.policy()
        if not policy.get("previous_collection"):
            raise ValueError("there is no cutover to undo")
        self.cutover(policy["active_collection"], policy["previous_collection"])
        return self.policy

    def staleness_by_strategy(self) -> list[dict]:
        """Active and inactive vectors by model and by strategy."""
        return [r.asDict() for r in lineage.active_flags(self.catalog.table("vectors"), self.catalog.table("chunks")).orderBy("name").collect()]

    def plan(self, model_name: str, model_version: str, strategy_name: str | None = None, batch_size: int = 64, rate: float = 1.0) -> dict:
        rows = migration.source_rows(self.catalog.table("vectors"), self.catalog.table("chunks"), model_name, model_version, strategy_name)
        return migration.plan_totals(rows, batch_size, rate).first().asDict()


def quality_gate(store: DataFrame, queries: DataFrame, qrels: DataFrame, baseline: str, candidate: str, recall_tolerance: float = 0.02, errors: DataFrame | None = None, catalog: Catalog | None = None, model: tuple[str, str] | None = None) -> dict:
    """Whether a candidate collection ranks as well as the baseline and answers without errors.

    queries: (query_id, vector by collection's length); errors: (query_id, error) of the candidate's attempts. With a
    catalog and its model a row for each side enters the run table."""
    from strataloom.operators import evaluation

    spark = store.sparkSession
    macros = {}
    for side, name in (("baseline", baseline), ("candidate", candidate)):
        hits = search.top_k(store.filter(F.col("collection_name") == name), queries, 10)
        macros[side] = cut_lineage(evaluation.macro(evaluation.query_metrics(qrels, hits.select("query_id", F.col("item_id").alias("doc_id"), "rank"))))
    none = spark.createDataFrame([], "query_id string, error string")
    rates = {"baseline": evaluation.error_rate(none), "candidate": evaluation.error_rate(none if errors is None else errors)}
    out = evaluation.gated(evaluation.gate(*macros.values(), recall_tolerance), rates["candidate"]).first().asDict()
    if catalog is not None and model is not None:
        catalog.insert("retrieval_eval_runs", cut_lineage(evaluation.run_rows(macros, model, f"{baseline}-{candidate}", rates, out["passed"])))
    return out


def as_table(rows: list[dict]) -> str:
    """Rows in aligned columns for a terminal."""
    if not rows:
        return "(nothing)"
    cells = [list(rows[0]), *([str(v) for v in r.values()] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells)


def main(argv: list[str] | None = None) -> int:
    """lineage ID | staleness MODEL VERSION | status | plan MODEL VERSION | apply MODEL VERSION MODEL VERSION COLLECTION ID |
    faults RATE | gate STORE QUERIES QRELS BASELINE CANDIDATE | cutover OFF ON | rollback | strategies, on a catalog folder.

    apply embeds with the deterministic stand-in; gate reads three Parquet folders and fails with 1 if it is not passed."""
    from strataloom.session import build_session

    parser = argparse.ArgumentParser(prog="strataloom", description=main.__doc__)
    parser.add_argument("--catalog", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("lineage").add_argument("vector_id")
    for name in ("staleness", "plan"):
        sub = commands.add_parser(name)
        sub.add_argument("model")
        sub.add_argument("version")
    for name in ("status", "rollback", "strategies"):
        commands.add_parser(name)
    for name, words in (("apply", ("model", "version", "to_model", "to_version", "collection", "migration")), ("faults", ("rate",)), ("gate", ("store", "queries", "qrels", "baseline", "candidate"))):
        sub = commands.add_parser(name)
        for word in words:
            sub.add_argument(word)
    sub = commands.add_parser("cutover")
    sub.add_argument("off")
    sub.add_argument("on")
    args = parser.parse_args(argv)
    policy: dict = {"active_model": args.model, "active_version": args.version} if args.command == "staleness" else {}
    service = Service(Catalog(build_session("local[*]"), args.catalog), policy=policy)
    if args.command == "lineage":
        try:
            out = service.lineage(args.vector_id)
        except KeyError as error:
            print(error.args[0])
            return 1
    elif args.command == "cutover":
        service.cutover(args.off, args.on)
        out = service.policy
    elif args.command == "strategies":
        print(as_table(service.staleness_by_strategy()))
        return 0
    elif args.command == "apply":
        dimensions = migration.find_model(service.catalog.table("embedding_models"), args.to_model, args.to_version)["dimensions"]
        done = migration.apply(service.catalog, (args.model, args.version), (args.to_model, args.to_version), args.collection, args.migration, migration.hash_embedder(dimensions), dimensions)
        out = {"vectors": done.vectors.count(), "batches": done.progress.count(), "failed_batches": done.failed_batches}
    elif args.command == "faults":
        drawn = migration.fault_ledger(service.catalog.table("vectors"), "vector_id", float(args.rate)).groupBy("fault").count()
        out = {str(r.fault): r["count"] for r in drawn.collect()}
    elif args.command == "gate":
        read = service.catalog.spark.read.parquet
        out = quality_gate(read(args.store), read(args.queries), read(args.qrels), args.baseline, args.candidate)
        if not out["passed"]:
            print(json.dumps(out))
            return 1
    else:
        out = {"staleness": service.staleness, "status": service.status, "rollback": service.rollback, "plan": lambda: service.plan(args.model, args.version)}[args.command]()
    print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
