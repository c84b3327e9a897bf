"""Which projects a service holds, and whether its copy of a corpus is out of date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Project:
    """A fleet's corpus and where its media lie."""

    name: str
    label: str
    corpus: str
    media: str = ""


@dataclass(frozen=True)
class Registry:
    """Known projects; `fallback` serves where a list names none of them."""

    known: Mapping[str, Project]
    fallback: str

    def enabled(self, names: str | None) -> list[str]:
        """Known projects of a comma list in its order, each once."""
        asked = [n.strip().lower() for n in (names or "").split(",")]
        return list(dict.fromkeys(n for n in asked if n in self.known)) or [self.fallback]

    def get(self, name: str | None, names: str | None = None, overrides: Mapping[str, str] | None = None) -> Project:
        """A project by name, else the first enabled one; overrides as `<project>_corpus` replace fields where not empty."""
        key = (name or self.enabled(names)[0]).strip().lower()
        if key not in self.known:
            raise KeyError(key)
        given = {f: v for f in ("label", "corpus", "media") if (v := (overrides or {}).get(f"{key}_{f}", "").strip())}
        return replace(self.known[key], **given)


def enabled(names: Column, known: Sequence[str], fallback: str) -> Column:
    """Registry.enabled of a column of lists."""
    asked = F.transform(F.split(F.coalesce(names, F.lit("")), ","), lambda n: F.lower(F.trim(n)))
    found = F.array_distinct(F.filter(asked, lambda n: n.isin(list(known))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))


def refresh_decision(status: Column, held: Column, latest: Column, resident: Column) -> Column:
    """What a scheduled look at a corpus does: a load under way and an absent corpus are left alone; an unknown version counts
    as changed."""
    same = held.isNotNull() & latest.isNotNull() & (held == latest)
    return F.when(status == "loading", "skip: loading").when(~resident, "skip: none resident").when(same, "skip: unchanged").otherwise("reload")
