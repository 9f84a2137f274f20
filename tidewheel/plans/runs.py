"""Registry of experiment runs: JSON manifests with a lease for each identity, on the file system that tables of the runs are on."""

from __future__ import annotations

import time
from contextlib import contextmanager
from pyspark.sql import SparkSession

from ..sources import files
from ..sources.config import flatten, signature

STATES = ("not_run", "running", "interrupted", "completed")
POLICIES = ("overwrite_exact", "overwrite_path", "new")
#: Seeds that results can be read of.
READABLE = ("ready", "completed")


class Registry:
    """Runs live in `root/<identity>/run_<k>/manifest.json`; the root is a URI (or a path of the session's default file system), the same for the driver and for tables."""

    def __init__(self, root: str, wait: float = 30.0, stale: float = 3600.0, spark: SparkSession | None = None):
        self.root, self.wait, self.stale = str(root).rstrip("/"), wait, stale
        self.spark = spark or SparkSession.active()

    @contextmanager
    def locked(self, identity: str):
        with files.lease(self.spark, f"{self.root}/{identity}/.lock", self.wait, self.stale):
            yield

    def manifests(self, identity: str | None = None) -> list[dict]:
        """All manifests but archived ones."""
        found = files.find(self.spark, f"{self.root}/{identity}" if identity else self.root, "manifest.json")
        return [files.read_json(self.spark, p) for p in found if "/archive/" not in p]

    def _path(self, identity: str, index: int) -> str:
        return f"{self.root}/{identity}/run_{index}/manifest.json"

    def manifest(self, identity: str, index: int) -> dict:
        return files.read_json(self.spark, self._path(identity, index))

    def _write(self, identity: str, run: dict) -> None:
        files.write_json(self.spark, self._path(identity, run["run_index"]), run)

    def allocate(self, identity: str, config: dict, seeds: list[int], purpose: str = "default", policy: str = "overwrite_exact") -> tuple[dict, str]:
        """(manifest, what to do): new, skip (completed with these seeds), resume (some seeds are missing) or overwrite."""
        if policy not in POLICIES:
            raise ValueError(policy)
        mark = signature(flatten(config))
        with self.locked(identity):
            runs = sorted(self.manifests(identity), key=lambda r: r["run_index"])
            same = [r for r in runs if r["signature"] == mark]
            if policy == "overwrite_exact" and same:
                run, known = same[-1], {int(s) for s, v in same[-1]["seed_status"].items() if v == "completed"}
                action = "skip" if set(seeds) <= known else "resume"
                run["purposes"] = sorted({*run["purposes"], purpose})
                run["seed_status"] |= {str(s): "not_run" for s in seeds if str(s) not in run["seed_status"]}
            else:
                index = runs[-1]["run_index"] if policy == "overwrite_path" and runs else max((r["run_index"] for r in runs), default=-1) + 1
                action = "overwrite" if policy == "overwrite_path" and runs else "new"
                run = {"schema": 1, "identity": identity, "run_index": index, "signature": mark, "config": flatten(config), "purposes": [purpose], "status": "not_run", "seed_status": {str(s): "not_run" for s in seeds}}
            self._write(identity, run)
            return run, action

    def _set(self, identity: str, index: int, seed: int | None, status: str) -> dict:
        with self.locked(identity):
            run = self.manifest(identity, index)
            if seed is not None:
                run["seed_status"][str(seed)] = status
            done = all(v == "completed" for v in run["seed_status"].values())
            run["status"] = "completed" if done else "interrupted" if status == "interrupted" else "running"
            if done:
                run["finished_at"] = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
            self._write(identity, run)
            return run

    def folder(self, identity: str, index: int) -> str:
        return self._path(identity, index).removesuffix("/manifest.json")

    def selections(self, identity: str) -> dict[str, dict]:
        """{signature: {mode, run_index}} of an identity; mode is auto or pinned."""
        path = f"{self.root}/{identity}/selected.json"
        found = files.read_json(self.spark, path) if files.exists(self.spark, path) else {}
        if bad := [k for k, v in found.items() if v.get("mode") not in ("auto", "pinned")]:
            raise ValueError(f"{path}: invalid selection {bad[0]}")
        return found

    def select(self, identity: str, signature: str, index: int, pinned: bool = True) -> None:
        """Makes a completed run the one that reports take for its signature. An automatic choice doesn't replace a pinned one."""
        run = self.manifest(identity, index)
        if run["status"] != "completed" or run["signature"] != signature:
            raise ValueError(f"{identity} run {index} is not a completed run of {signature}")
        with self.locked(identity):
            known = self.selections(identity)
            if pinned or known.get(signature, {}).get("mode") != "pinned":
                files.write_json(self.spark, f"{self.root}/{identity}/selected.json", known | {signature: {"mode": "pinned" if pinned else "auto", "run_index": index}})

    def selected(self, identity: str, signature: str) -> dict | None:
        choice = self.selections(identity).get(signature)
        return self.manifest(identity, choice["run_index"]) if choice else None

    def start(self, identity: str, index: int, seed: int) -> dict:
        return self._set(identity, index, seed, "running")

    def ready(self, identity: str, index: int, seed: int) -> dict:
        return self._set(identity, index, seed, "ready")

    def complete(self, identity: str, index: int, seed: int) -> dict:
        """Completes a seed; a run whose seeds are all complete becomes its signature's automatic selection."""
        run = self._set(identity, index, seed, "completed")
        if run["status"] == "completed":
            self.select(identity, run["signature"], index, pinned=False)
        return run

    def interrupt(self, identity: str, index: int) -> dict:
        """What was running did not end; completed seeds stay."""
        run = self.manifest(identity, index)
        for s, v in run["seed_status"].items():
            if v in ("running", "ready"):
                run = self._set(identity, index, int(s), "interrupted")
        return run

    def pending(self, identity: str, index: int) -> list[int]:
        return [int(s) for s, v in self.manifest(identity, index)["seed_status"].items() if v != "completed"]

    def single(self, identity: str) -> dict:
        """The only completed run; none or several fail."""
        done = [r for r in self.manifests(identity) if r["status"] == "completed"]
        if len(done) != 1:
            raise LookupError(f"{identity}: {len(done)} completed runs")
        return done[0]

    def validate(self, identity: str, index: int, artifacts: tuple[str, ...] = (), launch: str | None = None) -> dict:
        """The manifest of a run whose seeds are all completed (or ready, within the same launch) and whose artifacts, named below each seed's folder, are there; else an error that says what is missing."""
        run = self.manifest(identity, index)
        allowed = READABLE if launch is not None and launch in run["purposes"] else ("completed",)
        if bad := {k: v for k, v in run["seed_status"].items() if v not in allowed}:
            raise ValueError(f"{identity} run {index}: seeds {bad}")
        if run["signature"] != signature(run["config"]):
            raise ValueError(f"{identity} run {index}: its configuration isn't that of its signature")
        for seed in run["seed_status"]:
            for name in artifacts:
                if not files.exists(self.spark, path := f"{self.folder(identity, index)}/seed_{seed}/{name}"):
                    raise FileNotFoundError(path)
        return run

    def archive(self, identity: str, index: int) -> str:
        """Moves a run with its tables below `archive/`, where no selection or report finds it; selections of it are dropped. Its new folder."""
        with self.locked(identity):
            source, k = self.folder(identity, index), 0
            while files.exists(self.spark, target := f"{self.root}/{identity}/archive/run_{index}{f'_{k}' if k else ''}"):
                k += 1
            files.move(self.spark, source, target)
            known = self.selections(identity)
            kept = {s: v for s, v in known.items() if v["run_index"] != index}
            if kept != known:
                files.write_json(self.spark, f"{self.root}/{identity}/selected.json", kept)
        return target

    def clean(self, identity: str, index: int) -> list[str]:
        """Removes folders of seeds that are neither ready nor completed; their numbers."""
        with self.locked(identity):
            run, gone = self.manifest(identity, index), []
            for seed, state in run["seed_status"].items():
                folder = f"{self.folder(identity, index)}/seed_{seed}"
                if state not in READABLE and files.exists(self.spark, folder):
                    files.remove(self.spark, folder)
                    gone.append(seed)
        return gone

    def of_launch(self, launch: str) -> list[dict]:
        return [r for r in self.manifests() if launch in r["purposes"]]

    def interrupt_launch(self, launch: str) -> list[str]:
        """Folders of a launch's runs that were running and are interrupted now."""
        out = []
        for r in self.of_launch(launch):
            if r["status"] == "running":
                self.interrupt(r["identity"], r["run_index"])
                out.append(self.folder(r["identity"], r["run_index"]))
        return out

    def complete_launch(self, launch: str) -> list[str]:
        """Completes the ready seeds of a launch's runs; folders of runs that are completed by it."""
        out = []
        for r in self.of_launch(launch):
            if r["status"] == "completed":
                continue
            for seed in [s for s, v in r["seed_status"].items() if v == "ready"]:
                r = self.complete(r["identity"], r["run_index"], int(seed))
            if r["status"] == "completed":
                out.append(self.folder(r["identity"], r["run_index"]))
        return out

    def resolve(self, identity: str, config: dict | None = None, purposes: tuple[str, ...] = (), seeds: tuple[int, ...] = (), repeats: str = "selected") -> list[dict]:
        """Completed runs of an identity with these configuration values, any of the purposes and all of the seeds. Of repeats (equal signatures): the selected one (the latest where none is), the latest, or all (`distinct`). Each has its folder as run_dir."""
        if repeats not in ("selected", "latest", "distinct"):
            raise ValueError(repeats)
        wanted = flatten(config or {})
        fits = [r for r in self.manifests(identity) if r["status"] == "completed" and all(r["config"].get(k) == v for k, v in wanted.items()) and (not purposes or set(purposes) & set(r["purposes"])) and {str(s) for s in seeds} <= set(r["seed_status"])]
        by: dict[str, list[dict]] = {}
        for r in sorted(fits, key=lambda r: (r.get("finished_at", ""), r["run_index"])):
            by.setdefault(r["signature"], []).append(r | {"run_dir": self.folder(identity, r["run_index"])})
        if repeats == "distinct":
            return [r for runs in by.values() for r in runs]
        chosen = self.selections(identity) if repeats == "selected" else {}
        return [next((r for r in runs if r["run_index"] == chosen.get(mark, {}).get("run_index")), runs[-1]) for mark, runs in by.items()]


def write_matrix(registry: Registry, rows: list[dict], config: dict, launch: str = "smoke") -> list[dict]:
    """Registers the results of a matrix of small experiments: a run for each family and method, a `metrics.json` for each seed (rows have family, method, seed and values). Completed runs are left as they are."""
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        groups.setdefault((r["family"], r["method"]), []).append(r)
    out = []
    for (family, method), own in groups.items():
        identity = f"{family}/{method}"
        run, action = registry.allocate(identity, config | {"family": family, "method": method}, [r["seed"] for r in own], launch)
        if action != "skip":
            for r in own:
                registry.start(identity, run["run_index"], r["seed"])
                files.write_json(registry.spark, f"{registry.folder(identity, run['run_index'])}/seed_{r['seed']}/metrics.json", r)
                run = registry.complete(identity, run["run_index"], r["seed"])
            registry.validate(identity, run["run_index"], ("metrics.json",))
        out.append(run | {"run_dir": registry.folder(identity, run["run_index"])})
    return out


def seeded(config: dict, seeds: list[int]) -> list[dict]:
    """A configuration for each seed; only the first builds the data anew."""
    return [config | {"seed": s, "rebuild": bool(config.get("rebuild")) and i == 0} for i, s in enumerate(seeds)]
