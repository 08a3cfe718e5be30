"""Settings from the environment or a .env file; folders that follow from them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "GROUNDLOOM_"


@dataclass(frozen=True)
class Settings:
    """A field is read from ``GROUNDLOOM_<NAME>``; the environment goes before the file, the file before the defaults."""

    data_root: str = "data"
    outputs: str = "outputs"
    model: str = ""
    judge_model: str = ""
    service_url: str = "http://localhost:11434"
    service_key: str = ""
    concurrent: int = 4
    budget: float = 0.0

    def folder(self, name: str) -> str:
        """A folder of the data root: source, pages, extracted, grounding, prompts or synthetic."""
        if name not in ("source", "pages", "extracted", "grounding", "prompts", "synthetic"):
            raise ValueError(f"no such folder: {name}")
        return f"{self.data_root.rstrip('/')}/{name}"


def load(env_file: str | None = ".env", environ: dict[str, str] | None = None) -> Settings:
    """Typed settings; names that aren't fields are ignored, values of a wrong type are errors."""
    given = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not name.startswith("#"):
                given[name.strip().upper()] = value.strip().strip("'\"")
    given |= {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    kinds = {"str": str, "int": int, "float": float}
    return Settings(**{f.name: kinds[f.type](given[key]) for f in fields(Settings) if (key := PREFIX + f.name.upper()) in given})
