"""Rules over events before they are folded."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import UnknownException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import merge_maps, name_of
from ..sources.files import stored

#: Errors that carry no fault of a plan or row: jobs that were aborted, the file system, the way to the JVM.
_OUTAGES = (UnknownException, Py4JError, OSError, MemoryError)

#: A row of a plugin's report.
REPORT = "name string, class string, status string, error string, duration_ms long"

#: Kind -> builder from its JSON configuration.
REGISTRY: dict[str, Callable[[dict], "Plugin"]] = {}


def register(kind: str):
    def add(builder):
        REGISTRY[kind] = builder
        return builder

    return add


@dataclass
class Plugin:
    name: str
    apply: Callable[[DataFrame], DataFrame]


def task_is(name: str | None) -> Column:
    """Events of tasks with this name; without one, of all tasks."""
    return F.lit(True) if name is None else name_of(F.col("name"), F.col("task_id")) == name


@dataclass
class SwitchCase:
    """Sets a string by the first rule one of whose patterns is contained in a text field; a rule without patterns is the default."""

    search_field: str
    output: str
    rules: list[tuple[list[str] | None, str]]
    task_name: str | None = None
    name: str = "SwitchCase"

    def value(self, text: Column) -> Column:
        out = F.lit(None).cast("string")
        for patterns, value in reversed(self.rules):
            hit = F.lit(True) if patterns is None else F.lit(False)
            for p in patterns or []:
                hit = hit | F.contains(text, F.lit(p))
            out = F.when(hit, F.lit(value)).otherwise(out)
        return out

    def apply(self, events: DataFrame) -> DataFrame:
        text = F.col("text")[self.search_field]
        found = F.when(text.isNotNull() & task_is(self.task_name), self.value(text))
        strings = F.when(found.isNotNull(), merge_maps(F.col("strings"), F.create_map(F.lit(self.output), found))).otherwise(F.col("strings"))
        return events.withColumn("strings", strings)


@register("SwitchCase")
def _switch_case(conf: dict) -> SwitchCase:
    rules = [(r.get("match"), r["output"]) for r in conf["switch"]]
    return SwitchCase(conf["searchField"], conf["outputAttribute"], rules, (conf.get("taskMatcher") or {}).get("name"), conf.get("name") or "SwitchCase")


def from_json(config: str) -> list[Plugin]:
    """Plugins from a JSON list of {"class", ...}; one without a name is called after its class and place."""
    out = []
    for i, conf in enumerate(json.loads(config)):
        kind = conf["class"].rpartition(".")[2]
        out.append(REGISTRY[kind](conf | {"name": conf.get("name") or f"{kind}_{i}"}))
    return out


def run_all(events: DataFrame, plugins: list, proven: bool = False) -> tuple[DataFrame, list[dict]]:
    """Events after all plugins, and a report each; a plugin that fails is skipped and does not stop the batch.

    What is wrong with the cluster is no plugin's fault: lost executors, full disks and the like stop the batch, to be run again.

    A plan is only known to work once it has run: with ``proven`` each plugin's events are written before the next one
    starts, so that a plugin that fails at a row is skipped, too."""
    reports = []
    for p in plugins:
        began, status, error = time.time(), "SUCCESS", None
        try:
            changed = p.apply(events)
            changed.schema  # a plan that does not resolve fails here
            events = stored(changed, "plugin") if proven else changed
        except _OUTAGES:
            raise
        except Exception:
            status, error = "ERROR", traceback.format_exc()
        reports.append({"name": p.name, "class": type(p).__name__, "status": status, "error": error, "duration_ms": int((time.time() - began) * 1000)})
    return events, reports
