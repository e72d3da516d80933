"""Columns of the event files and side files, by event."""

from __future__ import annotations

# Every event file has these: time in ns, the CPU that wrote it, and the task running then.
HEADER = "common_ts bigint, common_cpu bigint, common_pid bigint, common_comm string"

# Fields of each event file, and the projection to the columns the analyses use.
EVENT_FIELDS = {
    "cpu_idle": "cpu bigint, state bigint",
    "cpu_idle_miss": "cpu_id bigint, state bigint, below bigint",
    "cpu_frequency": "state bigint, cpu_id bigint",
    "sched_switch": "prev_comm string, prev_pid bigint, prev_state bigint, next_comm string, next_pid bigint",
    "sched_wakeup": "comm string, pid bigint, target_cpu bigint",
    "sched_wakeup_new": "comm string, pid bigint, target_cpu bigint",
    "task_rename": "pid bigint, oldcomm string, newcomm string",
    "cgroup_attach_task": "dst_path string, pid bigint, comm string",
    "uclamp_update_tsk": "pid bigint, uclamp_id bigint, value bigint",
    "pixel6_emeter": "chan_name string, value bigint, ts bigint",
    "sched_pelt_cfs": "cpu bigint, path string, load bigint, util bigint",
    "sched_cpu_capacity": "cpu bigint, capacity bigint",
    "sched_overutilized": "overutilized bigint",
    "perf_counter": "cpu bigint, counter_id bigint, value bigint",
}
PROJECTIONS = {
    "cpu_idle": ["cast(cpu as int) as cpu", "state"],
    "cpu_idle_miss": ["cast(cpu_id as int) as cpu_id", "below"],
    "cpu_frequency": ["cast(cpu_id as int) as cpu", "state as frequency"],
    "sched_switch": ["cast(common_cpu as int) as cpu", "prev_pid", "prev_comm", "next_pid", "next_comm"],
    "sched_wakeup": ["pid", "comm", "cast(target_cpu as int) as target_cpu"],
    "sched_wakeup_new": ["pid", "comm", "cast(target_cpu as int) as target_cpu"],
    "task_rename": ["pid", "oldcomm", "newcomm"],
    "cgroup_attach_task": ["pid", "comm", "dst_path"],
    "uclamp_update_tsk": ["pid", "uclamp_id", "value"],
    "pixel6_emeter": ["chan_name", "value"],
    "sched_pelt_cfs": ["cast(cpu as int) as cpu", "path", "load", "util"],
    "sched_cpu_capacity": ["cast(cpu as int) as cpu", "capacity"],
    "sched_overutilized": ["overutilized"],
    "perf_counter": ["cast(cpu as int) as cpu", "counter_id", "value"],
}

# Events a run is expected to have, when nothing else is said.
EXPECTED_EVENTS = (
    "cpu_frequency", "sched_switch", "sched_wakeup", "sched_wakeup_new", "task_rename", "cpu_idle", "cpu_idle_miss",
    "cgroup_attach_task", "uclamp_update_tsk", "pixel6_emeter", "sched_pelt_cfs", "sched_cpu_capacity",
    "sched_overutilized",
)

# Side files: pattern of the file name, columns and their types. An ADPF report has further double columns.
SIDE_FILES = {
    "thermal": ("*poller*.csv", {"time": "double"}, "bigint"),
    "adpf": ("*adpf*.csv", {}, "double"),
    "frames": ("*frames*.csv", {}, "bigint"),
}
RENAMED = {"time since start": "time"}

# The columns of an ADPF report.
ADPF_COLUMNS = (
    "time since start", "# frame count",
    "average fps", "sigma fps", "thermal status",
    "Adaptive Batching", "sn_Adaptive Batching", "Adaptive Decals", "sn_Adaptive Decals",
    "Adaptive Framerate", "sn_Adaptive Framerate", "Adaptive LOD", "sn_Adaptive LOD", "Adaptive Lut", "sn_Adaptive Lut",
    "Adaptive MSAA", "sn_Adaptive MSAA", "Adaptive Resolution", "sn_Adaptive Resolution",
    "Adaptive Shadow Cascade", "sn_Adaptive Shadow Cascade", "Adaptive Shadow Distance", "sn_Adaptive Shadow Distance",
    "Adaptive Shadowmap Resolution", "sn_Adaptive Shadowmap Resolution",
    "Adaptive Shadow Quality", "sn_Adaptive Shadow Quality", "Adaptive Transparency", "sn_Adaptive Transparency",
    "Adaptive View Distance", "sn_Adaptive View Distance", "Adaptive Sorting", "sn_Adaptive Sorting",
    "Adaptive Physics", "sn_Adaptive Physics", "Adaptive Layer Culling", "sn_Adaptive Layer Culling",
    "Adaptive Fog", "sn_Adaptive Fog",
)
