"""Declarative pipelines: named sources + ordered steps folded into one
lazy DataFrame plan.  Catalyst does all optimisation; the builder only
resolves each step (so an analysis error names the failing step) and never
collects intermediate results."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import transforms as tf
from tessera.functions.columns import as_names


@dataclass
class Step:
    op: str
    params: dict = field(default_factory=dict)
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])
    enabled: bool = True


class PipelineError(ValueError):
    def __init__(self, step: Step, cause: Exception):
        super().__init__(f"step {step.id} ({step.op}) failed: {cause}")
        self.step = step
        self.cause = cause


def _need(params: dict, *names: str):
    missing = [n for n in names if n not in params]
    if missing:
        raise ValueError(f"missing parameter(s) {missing}")


def apply_step(df: DataFrame, op: str, params: dict, sources: dict[str, DataFrame]) -> DataFrame:
    """Dispatch one registry op.  Unknown ops raise (the reference silently
    passes rows through)."""
    p = dict(params or {})
    if op == "select_columns":
        return tf.select_columns(df, p.get("columns", ""), bool(p.get("strict", False)))
    if op == "drop_columns":
        return tf.drop_columns(df, p.get("columns", ""))
    if op == "rename_columns":
        return tf.rename_columns(df, p.get("mapping", {}))
    if op == "filter_rows":
        _need(p, "column", "operator")
        return tf.filter_rows(df, p["column"], p["operator"], p.get("value", ""))
    if op == "drop_nulls":
        return tf.drop_nulls(df, p.get("columns", ""))
    if op == "fill_nulls":
        _need(p, "column")
        return tf.fill_nulls(df, p["column"], p.get("strategy", "value"), p.get("value", ""),
                             p.get("order_by"), p.get("partition_by"))
    if op == "cast_type":
        _need(p, "column", "dtype")
        return tf.cast_type(df, p["column"], p["dtype"], bool(p.get("keep_bad", False)))
    if op == "add_column":
        _need(p, "name", "expression")
        return tf.add_column(df, p["name"], p["expression"])
    if op == "deduplicate":
        if df.isStreaming and p.get("watermark"):
            from tessera.streaming import dedup_stream
            return dedup_stream(df, as_names(p.get("columns", "")) or df.columns, p["watermark"],
                                p.get("delay", "10 minutes"))
        return tf.deduplicate(df, p.get("columns", ""), p.get("order_by"))
    if op == "sort":
        _need(p, "column")
        return tf.sort(df, p["column"], bool(p.get("descending", False)), p.get("tie_break"))
    if op == "limit":
        return tf.limit(df, int(p.get("n", 1000)))
    if op == "sample":
        return tf.sample(df, int(p.get("n", 100)), p.get("seed", 0), p.get("key"))
    if op == "text_clean":
        _need(p, "column")
        flags = {k: bool(p[k]) for k in ("strip", "lowercase", "remove_html", "remove_urls",
                                         "remove_special", "unicode") if k in p}
        return tf.text_clean(df, p["column"], **flags)
    if op == "text_split":
        _need(p, "column")
        return tf.text_split(df, p["column"], int(p.get("max_length", 512)), int(p.get("overlap", 50)))
    if op == "flatten_json":
        _need(p, "column")
        return tf.flatten_json(df, p["column"], p.get("schema"))
    if op == "merge":
        _need(p, "right_source_id", "on")
        rid = p["right_source_id"]
        if rid not in sources:
            raise ValueError(f"unknown source {rid!r}")
        return tf.merge(df, sources[rid], p["on"], p.get("how", "inner"), p.get("right_on"),
                        bool(p.get("null_safe", True)), split_heavy=bool(p.get("split_heavy", False)))
    if op == "concat":
        _need(p, "source_id")
        sid = p["source_id"]
        if sid not in sources:
            raise ValueError(f"unknown source {sid!r}")
        return tf.concat(df, sources[sid])
    raise ValueError(f"unknown op {op!r}")


REGISTRY = ("select_columns", "drop_columns", "rename_columns", "filter_rows", "drop_nulls",
            "fill_nulls", "cast_type", "add_column", "deduplicate", "sort", "limit", "sample",
            "text_clean", "text_split", "flatten_json", "merge", "concat")


class Pipeline:
    """Ordered steps over named sources.  ``build()`` returns the lazy plan."""

    def __init__(self, name: str = "", spark: SparkSession | None = None):
        self.id = uuid.uuid4().hex[:8]
        self.name = name or f"unnamed-{self.id}"
        self.spark = spark
        self.sources: dict[str, DataFrame] = {}
        self.steps: list[Step] = []

    # specs ---------------------------------------------------------------
    @classmethod
    def from_spec(cls, spark: SparkSession, spec: dict | str) -> "Pipeline":
        """Build from ``{"name", "sources": {id: {connector_type, params}},
        "transforms": [{"id", "op", "params", "enabled"}]}`` (dict or JSON).
        Connection secrets stay with the caller; nothing is written out."""
        import json
        if isinstance(spec, str):
            spec = json.loads(spec)
        p = cls(spec.get("name", ""), spark)
        for sid, src in (spec.get("sources") or {}).items():
            p.add_source(sid, src)
        for t in spec.get("transforms") or spec.get("steps") or []:
            p.add_step(t["op"], t.get("params", {}), t.get("id"), bool(t.get("enabled", True)))
        return p

    def to_spec(self) -> dict:
        """Steps only: sources are live DataFrames and are not serialised."""
        return {"name": self.name, "transforms": [{"id": s.id, "op": s.op, "params": s.params,
                                                   "enabled": s.enabled} for s in self.steps]}

    # sources -------------------------------------------------------------
    def add_source(self, source_id: str, source) -> "Pipeline":
        if isinstance(source, DataFrame):
            self.sources[source_id] = source
        else:
            from tessera.sources.files import load_source
            if self.spark is None:
                raise ValueError("a SparkSession is needed to load source specs")
            self.sources[source_id] = load_source(self.spark, source)
        return self

    # steps ---------------------------------------------------------------
    def add_step(self, op: str, params: dict | None = None, step_id: str | None = None,
                 enabled: bool = True) -> "Pipeline":
        if op not in REGISTRY:
            raise ValueError(f"unknown op {op!r}")
        s = Step(op, dict(params or {}), enabled=enabled)
        if step_id:
            s.id = step_id
        self.steps.append(s)
        return self

    def set_enabled(self, step_id: str, enabled: bool) -> "Pipeline":
        self._find(step_id).enabled = enabled
        return self

    def remove_step(self, step_id: str) -> "Pipeline":
        self.steps = [s for s in self.steps if s.id != step_id]
        return self

    def reorder(self, step_ids) -> "Pipeline":
        ids = as_names(step_ids)
        by_id = {s.id: s for s in self.steps}
        if sorted(ids) != sorted(by_id):
            raise ValueError("reorder must list every step id once")
        self.steps = [by_id[i] for i in ids]
        return self

    def _find(self, step_id: str) -> Step:
        for s in self.steps:
            if s.id == step_id:
                return s
        raise ValueError(f"unknown step {step_id!r}")

    # run -----------------------------------------------------------------
    def build(self, primary: str | None = None) -> DataFrame:
        if not self.sources:
            raise ValueError("pipeline has no sources")
        key = primary or next(iter(self.sources))
        if key not in self.sources:
            raise ValueError(f"unknown source {key!r}")
        df = self.sources[key]
        for s in self.steps:
            if not s.enabled:
                continue
            try:
                if df.isStreaming:
                    from tessera.streaming import check_stream_step
                    right = self.sources.get(s.params.get("right_source_id") or s.params.get("source_id", ""))
                    check_stream_step(df, s.op, s.params, right)
                df = apply_step(df, s.op, s.params, self.sources)
                df.schema  # force analysis so errors name this step
            except PipelineError:
                raise
            except Exception as exc:  # noqa: BLE001 - re-raised with the step id
                raise PipelineError(s, exc) from exc
        return df

    def run(self, primary: str | None = None, preview: int = 50) -> dict:
        df = self.build(primary)
        return {"count": df.count(), "columns": df.columns,
                "preview": [r.asDict(recursive=True) for r in df.limit(preview).collect()]}

    def write(self, spec: dict, primary: str | None = None) -> None:
        """Send the result to a sink ``{connector_type, params}``: csv,
        json / jsonl, parquet (files), jdbc vendors, kafka, mongodb,
        elasticsearch.  Redis / BigQuery raise: no connector is configured
        (the reference reports success without writing)."""
        from tessera.sources import sinks
        from tessera.sources.connectors import JDBC_VENDORS
        df = self.build(primary)
        kind = spec.get("connector_type") or spec.get("type")
        p = dict(spec.get("params", {}))
        if kind in ("csv", "csv_file"):
            sinks.write_csv(df, p["path"], p.get("mode", "overwrite"), p.get("delimiter", ","))
        elif kind in ("json", "json_file", "jsonl"):
            sinks.write_jsonl(df, p["path"], p.get("mode", "overwrite"))
        elif kind == "parquet":
            sinks.write_parquet(df, p["path"], p.get("mode", "overwrite"), p.get("partition_by"))
        elif kind in JDBC_VENDORS:
            table = p.pop("table")
            sinks.write_jdbc(df, kind, table, **p)
        elif kind == "kafka":
            sinks.write_kafka(df, p["bootstrap"], p["topic"], p.get("key"))
        elif kind == "mongodb":
            sinks.write_mongo(df, p["uri"], p["database"], p["collection"])
        elif kind == "elasticsearch":
            sinks.write_elasticsearch(df, p["nodes"], p["index"])
        else:
            sinks.unsupported_sink(kind)

    def stats(self, primary: str | None = None):
        from tessera.operators.profile import profile
        return profile(self.build(primary))
