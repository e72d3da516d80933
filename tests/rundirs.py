"""Run directories with a few hand-made events, for tests."""

import pyarrow as pa
import pyarrow.parquet as pq

S = 1_000_000_000  # ns
RUN_A, RUN_B = "speedometer_base_2_0809", "speedometer_new_idea_2_0809"
NOT_PRESENTED = 9223372036854775807


def event(job, name, rows):
    """Write rows of ``(seconds, cpu, fields)`` as one event file."""
    folder = job / "trace-events"
    folder.mkdir(parents=True, exist_ok=True)
    table = {
        "common_ts": [int(t * S) for t, _, _ in rows], "common_cpu": [c for _, c, _ in rows],
        "common_pid": [0] * len(rows), "common_comm": ["x"] * len(rows),
    }
    for field in rows[0][2]:
        table[field] = [r[field] for _, _, r in rows]
    pq.write_table(pa.table(table), folder / f"{name}.pq")


def switch(t, cpu, prev, following):
    names = {0: "swapper/0", 1: "CrGpuMain", 2: "a:b", 3: "Compositor", 9: "HwBinder"}
    return (t, cpu, {
        "prev_comm": names[prev], "prev_pid": prev, "prev_state": 0,
        "next_comm": names[following], "next_pid": following,
    })


def write_job(root, run, iteration, shift=0.0):
    """One iteration. Its window is 10 s to 20 s; ``shift`` moves the second switch of cpu 0."""
    job = root / run / f"wk1-speedometer-{iteration}"
    event(job, "sched_switch", [
        switch(10, 0, 0, 1), switch(12 + shift, 0, 1, 2), switch(15, 0, 2, 1), switch(16, 4, 0, 3), switch(18, 0, 1, 0),
    ])
    # two wakeups before one switch-in, and one that is never followed
    event(job, "sched_wakeup", [
        (13, 0, {"comm": "CrGpuMain", "pid": 1, "target_cpu": 4}),
        (14, 0, {"comm": "CrGpuMain", "pid": 1, "target_cpu": 5}),
        (19, 0, {"comm": "Compositor", "pid": 3, "target_cpu": 7}),
    ])
    # both mid CPUs idle together from 12 to 14 (state at least 0) and from 13 to 14 (state 1)
    event(job, "cpu_idle", [
        (11, 4, {"cpu": 4, "state": 1}), (12, 5, {"cpu": 5, "state": 0}), (13, 5, {"cpu": 5, "state": 1}),
        (14, 4, {"cpu": 4, "state": 4294967295}), (20, 5, {"cpu": 5, "state": 4294967295}),
    ])
    event(job, "cpu_idle_miss", [
        (11, 4, {"cpu_id": 4, "state": 1, "below": 0}), (12, 5, {"cpu_id": 5, "state": 1, "below": 1}),
        (13, 5, {"cpu_id": 5, "state": 1, "below": 1}),
    ])
    # the same frequency again changes nothing
    event(job, "cpu_frequency", [
        (10, 4, {"state": 500_000, "cpu_id": 4}), (12, 4, {"state": 500_000, "cpu_id": 4}),
        (13, 4, {"state": 900_000, "cpu_id": 4}), (10, 5, {"state": 700_000, "cpu_id": 5}),
    ])
    event(job, "cgroup_attach_task", [
        (10, 0, {"dst_path": "/background", "pid": 1, "comm": "CrGpuMain"}),
        (11, 0, {"dst_path": "/foreground", "pid": 1, "comm": "CrGpuMain"}),
        (12, 0, {"dst_path": "/background", "pid": 1, "comm": "CrGpuMain"}),
        (12, 0, {"dst_path": "/top-app", "pid": 2, "comm": "a:b"}),
    ])
    event(job, "uclamp_update_tsk", [
        (11, 0, {"pid": 1, "uclamp_id": 0, "value": 100}), (12, 0, {"pid": 77, "uclamp_id": 0, "value": 5}),
    ])
    event(job, "lisa__pixel6_emeter", [
        (10, 0, {"chan_name": "CPU(big)", "value": 0, "ts": 0}), (12, 0, {"chan_name": "CPU(big)", "value": 4_000_000, "ts": 0}),
        (10, 0, {"chan_name": "GPU", "value": 0, "ts": 0}), (14, 0, {"chan_name": "GPU", "value": 2_000_000, "ts": 0}),
    ])
    event(job, "lisa__sched_overutilized", [
        (11, 0, {"overutilized": 1}), (13, 0, {"overutilized": 0}), (19.5, 0, {"overutilized": 1}),
    ])
    event(job, "lisa__sched_pelt_cfs", [
        (11, 0, {"cpu": 0, "path": "/", "load": 10, "util": 20}), (12, 1, {"cpu": 1, "path": "/", "load": 30, "util": 40}),
        (13, 0, {"cpu": 0, "path": "/x", "load": 999, "util": 999}),
    ])
    event(job, "lisa__sched_cpu_capacity", [(12, 0, {"cpu": 6, "capacity": 900})])
    event(job, "perf_counter", [
        (11, 0, {"cpu": 0, "counter_id": 17, "value": 100}), (12, 0, {"cpu": 0, "counter_id": 17, "value": 150}),
        (13, 0, {"cpu": 0, "counter_id": 17, "value": 170}),
    ])
    (job / "poller-output.csv").write_text(
        "time,thermal_zone0-temp,thermal_zone1-temp,thermal_zone2-temp\n1.0,50000,40000,30000\n2.0,52000,42000,32000\n"
    )
    (job / "adpf.csv").write_text("time since start,# frame count,average fps\n0.5,10,30\n1.5,45,50\n1.0,20,40\n")
    frames = [(100, 100, 90), (120, 130, 110), (140, NOT_PRESENTED, 130), (150, 180, 160)]
    (job / "frames.csv").write_text("desired_present_time_us,actual_present_time_us,frame_ready_time_us\n" + "\n".join(
        f"{d * 10**6},{p if p == NOT_PRESENTED else p * 10**6},{r * 10**6}" for d, p, r in frames
    ) + "\n")
    return job


def write_runs(root):
    for run, shift in ((RUN_A, 0.0), (RUN_B, 1.0)):
        for iteration in (1, 2):
            write_job(root, run, iteration, shift)
