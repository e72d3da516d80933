"""Settings of the target and of the analysis, and the small tables made from them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from runweave.errors import MissingConfig

# The target's layout, the counters, zones and task lists a run is read with.
CLUSTERS = {"little": (0, 1, 2, 3), "mid": (4, 5), "big": (6, 7)}
CGROUPS = ("background", "foreground", "system-background")
PERF_COUNTER_IDS = {
    0x0011: "CPU_CYCLES",
    0x8: "INST_RETIRED",
    0x1B: "INST_SPEC",
    0x22: "BR_MIS_PRED_RETIRED",
    0x23: "STALL_FRONTEND",
    0x24: "STALL_BACKEND",
    0x4005: "STALL_BACKEND_MEM",
    0x0004: "L1D_CACHE",
    0x0003: "L1D_CACHE_MISS",
    0x2B: "L3D_CACHE",
    0x2A: "L3D_CACHE_MISS",
}
THERMAL_ZONES = {
    "thermal_zone0-temp": "big",
    "thermal_zone1-temp": "mid",
    "thermal_zone2-temp": "little",
}
IMPORTANT_TASKS = {
    "jankbench": ("RenderThread", "droid.benchmark", "surfaceflinger", "decon0_kthread"),
    "geekbench": ("AsyncTask #1", "labs.geekbench6", "surfaceflinger"),
    "speedometer": (
        "CrRendererMain", "ThreadPoolForeg", ".android.chrome", "CrGpuMain", "Compositor",
        "Chrome_IOThread", "surfaceflinger", "RenderThread",
    ),
    "drarm": (
        "UnityMain", "UnityGfxDeviceW", "Thread-7", "Thread-6", "Thread-5", "Thread-4",
        "surfaceflinger", "mali-cmar-backe", "mali_jd_thread", "writer", "FastMixer",
        "RenderEngine", "Audio Mixer Thr", "UnityChoreograp",
    ),
    "fortnite": (
        "GameThread", "RHIThread", "RenderThread 0", "AudioMi-nder(1)", "Foregro-rker #1",
        "Foregro-rker #0", "Backgro-rker #2", "Backgro-rker #3", "mali-cmar-backe",
        "FastMixer", "surfaceflinger", "writer", "ElectraPlayer::", "MediaCodec_loop",
        "RenderEngine", "mali-compiler", "mali_jd_thread", "oid.aac.decoder",
    ),
}
PERF_COUNTERS = (
    "cpu-migrations", "context-switches", "stalled-cycles-backend", "page-faults",
    "major-faults", "cache-misses", "instructions", "cpu-cycles", "cpu-clock",
)


@dataclass(frozen=True)
class Options:
    """Everything a metric is parameterised with.

    ``opp`` rows are (cluster, kHz, capacity, power) and ``idle_power`` rows are
    (cluster, state, power); both empty means that no energy model is known.

    Ordered work is cut into time slices of about ``rows_per_slice`` rows of an iteration, so no
    task gets a whole hot group. ``sliced=False`` says that every group of every event is small
    enough for a plain window.
    """

    clusters: Mapping[str, tuple[int, ...]] = field(default_factory=lambda: dict(CLUSTERS))
    cgroups: tuple[str, ...] = CGROUPS
    perf_counter_ids: Mapping[int, str] = field(default_factory=lambda: dict(PERF_COUNTER_IDS))
    thermal_zones: Mapping[str, str] = field(default_factory=lambda: dict(THERMAL_ZONES))
    important_tasks: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(IMPORTANT_TASKS))
    perf_counters: tuple[str, ...] = PERF_COUNTERS
    opp: tuple[tuple[str, int, float, float], ...] = ()
    idle_power: tuple[tuple[str, int, float], ...] = ()
    allow_missing: bool = False
    sliced: bool = True
    rows_per_slice: int = 2_000_000

    def overridden(self, values: Mapping) -> Options:
        """A copy with some settings replaced; an unknown name is an error."""
        known = {f.name for f in fields(self)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise MissingConfig(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **values)

    @classmethod
    def from_json(cls, text: str) -> Options:
        """Settings from a JSON object; JSON lists become tuples and counter ids integers."""
        raw = json.loads(text)
        values = {}
        for name, value in raw.items():
            if name == "perf_counter_ids":
                value = {int(k, 0): v for k, v in value.items()}
            elif isinstance(value, dict):
                value = {k: tuple(v) if isinstance(v, list) else v for k, v in value.items()}
            elif isinstance(value, list):
                value = tuple(tuple(v) if isinstance(v, list) else v for v in value)
            values[name] = value
        return cls().overridden(values)

    @property
    def cpus(self) -> list[int]:
        return [cpu for members in self.clusters.values() for cpu in members]

    @property
    def cluster_names(self) -> list[str]:
        return list(self.clusters)

    def tasks_of(self, label: str) -> tuple[str, ...]:
        if label not in self.important_tasks:
            raise MissingConfig(f"workload {label} has no list of important tasks")
        return tuple(self.important_tasks[label])

    # Lookups of a few settings are plain expressions: no join, nothing to broadcast.

    def cluster_of(self, cpu: str | Column) -> Column:
        """Name of the cluster a CPU is in; null for a CPU of no cluster."""
        cpu = F.col(cpu) if isinstance(cpu, str) else cpu
        return _lookup(cpu, [(list(members), F.lit(name)) for name, members in self.clusters.items()])

    def cluster_size(self, cluster: str | Column) -> Column:
        cluster = F.col(cluster) if isinstance(cluster, str) else cluster
        return _lookup(cluster, [([name], F.lit(len(members))) for name, members in self.clusters.items()])

    def cluster_order(self, cluster: str | Column) -> Column:
        """Rank of a cluster in the settings; ``total`` comes after all of them."""
        cluster = F.col(cluster) if isinstance(cluster, str) else cluster
        return _lookup(cluster, [([name], F.lit(i)) for i, name in enumerate([*self.clusters, "total"])])

    def counter_name(self, counter_id: str | Column) -> Column:
        counter_id = F.col(counter_id) if isinstance(counter_id, str) else counter_id
        return _lookup(counter_id, [([key], F.lit(name)) for key, name in self.perf_counter_ids.items()])

    # Tables made of settings: their size is that of the settings, whatever the data.

    def opp_table(self, spark: SparkSession) -> DataFrame:
        self._need_model()
        return local_table(
            spark, self.opp, "cluster string, frequency long, capacity double, active_power double"
        )

    def idle_power_table(self, spark: SparkSession) -> DataFrame:
        self._need_model()
        return local_table(spark, self.idle_power, "cluster string, state long, idle_power double")

    def _need_model(self) -> None:
        if not (self.opp and self.idle_power):
            raise MissingConfig("no energy model: set Options.opp and Options.idle_power")


def _lookup(key: Column, choices: list[tuple[list, Column]]) -> Column:
    found = F.lit(None)
    for members, result in reversed(choices):
        found = F.when(key.isin(members), result).otherwise(found)
    return found


def local_table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A few driver-side rows as a table whose exact size the optimizer knows."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(list(c), type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema)


def energy_model(model: Mapping[str, Mapping]) -> dict[str, tuple]:
    """``opp`` and ``idle_power`` settings from a nested platform description.

    ``model`` maps a cluster to ``{"opp": {kHz: {"capacity": c, "power": p}}, "idle": {state: p}}``.
    """
    opp = tuple(
        (cluster, int(freq), float(point["capacity"]), float(point["power"]))
        for cluster, part in model.items()
        for freq, point in part["opp"].items()
    )
    idle = tuple(
        (cluster, int(state), float(power)) for cluster, part in model.items() for state, power in part["idle"].items()
    )
    return {"opp": opp, "idle_power": idle}
