"""Stages run in order, with critical and other stages told apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Stage:
    name: str
    run: Callable[[dict], object]
    critical: bool = True


@dataclass
class Report:
    done: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.failed and not self.skipped


def run_stages(stages: list[Stage]) -> tuple[dict, Report]:
    """Results by stage name and what became of each stage.

    A stage gets the results so far. A failed critical stage skips all after it; a
    failed other stage is reported as failed, and the rest go on."""
    results: dict[str, object] = {}
    report = Report()
    for i, s in enumerate(stages):
        try:
            results[s.name] = s.run(results)
            report.done.append(s.name)
        except Exception as e:
            report.failed[s.name] = f"{type(e).__name__}: {e}"[:500]
            if s.critical:
                report.skipped = [x.name for x in stages[i + 1 :]]
                break
    return results, report


def run_parts(parts: list, load: Callable[[object], object]) -> tuple[dict, Report]:
    """Results by part, such as the quarters of a backfill, each apart from the others: a
    part that fails is reported, and the rest are loaded."""
    results: dict[object, object] = {}
    report = Report()
    for p in parts:
        try:
            results[p] = load(p)
            report.done.append(str(p))
        except Exception as e:
            report.failed[str(p)] = f"{type(e).__name__}: {e}"[:500]
    return results, report
