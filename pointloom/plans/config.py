"""Configuration of a run: paths, defaults and categories."""

from __future__ import annotations

import copy
from dataclasses import fields
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from pointloom.operators.edits import next_version
from pointloom.operators.rooms import Room
from pointloom.sources.files import names, read_text, write_text

#: Steps whose settings a category inherits key by key; its placement is its own as a whole.
MERGED = ("segmentation", "extraction", "filtering", "healing", "scene")


class Config:
    """A run's settings; reading never changes them."""

    def __init__(self, tree: dict, root: str = "."):
        self.tree, self.root = tree, root.rstrip("/")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        import yaml

        tree = yaml.safe_load(read_text(spark, path))
        base = path.rsplit("/", 1)[0] if "/" in path else "."
        return cls(tree, f"{base}/{tree.get('paths', {}).get('data_root', '.')}")

    @property
    def project_dir(self) -> str:
        return f"{self.root}/projects/{self.tree['project']['name']}"

    def run_dir(self, now: datetime | None = None) -> str:
        run = self.tree.get("paths", {}).get("run_id", "auto")
        return f"{self.project_dir}/runs/{(now or datetime.now()).strftime('run_%Y%m%d_%H%M%S') if run == 'auto' else run}"

    def enabled(self) -> list[str]:
        """Categories that are switched on; by default they are off."""
        return [n for n, c in self.tree.get("categories", {}).items() if c.get("enabled", False)]

    def category(self, name: str) -> dict[str, Any]:
        """A category's settings over the defaults of its steps."""
        if name not in self.tree.get("categories", {}):
            raise ValueError(f"no category {name}")
        own = copy.deepcopy(self.tree["categories"][name])
        defaults = self.tree.get("defaults", {})
        return own | {step: copy.deepcopy(defaults.get(step, {})) | own.get(step, {}) for step in MERGED}

    def input_path(self, kind: str, category: str | None = None) -> str:
        """An input (point_cloud, transforms, dataparser, frames) of the category, else the shared one."""
        own = self.tree.get("categories", {}).get(category, {}).get("input", {}) if category else {}
        found = own.get(kind) or self.tree.get("paths", {}).get("input", {}).get(kind)
        if not found:
            raise ValueError(f"no path for {kind}")
        return f"{self.project_dir}/{found}"

    def templates(self, spark: SparkSession) -> list[str]:
        """Names of templates in order."""
        return [n for n in names(spark, f"{self.root}/{self.tree.get('paths', {}).get('stl_templates', 'stl_templates')}") if n.lower().endswith(".stl")]

    def room(self) -> Room:
        own = self.tree.get("room", {})
        known = {f.name for f in fields(Room)}
        vents = tuple(own.get("vents", ())) if own.get("vents_enabled", False) else ()
        return Room(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known and k != "vents"}, vents=vents)

    def save_copy(self, spark: SparkSession, run_dir: str) -> str:
        """A numbered copy beside the run's results."""
        import yaml

        path = f"{run_dir}/config_v{next_version(names(spark, run_dir))}.yaml"
        write_text(spark, path, yaml.safe_dump(self.tree, sort_keys=False))
        return path
