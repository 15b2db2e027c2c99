"""Recipes: what a run selects, how it shows pixels, and how it labels and splits."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from voxelframe.functions.hashing import stable_hash
from voxelframe.functions.labels import POLICIES
from voxelframe.operators.splits import check_ratios
from voxelframe.sources.dicom import NATIVE


@dataclass(frozen=True)
class DicomSection:
    modalities: tuple[str, ...] = ()
    views: tuple[str, ...] = ()
    require_single_frame: bool = True
    allow_transfer_syntaxes: tuple[str, ...] = NATIVE
    unsupported_transfer_syntax: str = "fail"


@dataclass(frozen=True)
class PresentationSection:
    apply_rescale: bool = True
    voi: str = "auto"
    invert_monochrome1: bool = True
    output: str = "mono8"


@dataclass(frozen=True)
class ImageSection:
    size: tuple[int, int] = (512, 512)
    resize: str = "fit"
    pad_value: int = 0
    normalize: str = "train_split_mean_std"


@dataclass(frozen=True)
class LabelSection:
    targets: tuple[str, ...] = ()
    uncertain: str = "ignore"
    missing: str = "ignore"


@dataclass(frozen=True)
class SplitSection:
    by: str = "patient_id"
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    stratify: tuple[str, ...] = ()
    seed: int = 0


@dataclass(frozen=True)
class Recipe:
    name: str
    dicom: DicomSection = field(default_factory=DicomSection)
    presentation: PresentationSection = field(default_factory=PresentationSection)
    image: ImageSection = field(default_factory=ImageSection)
    labels: LabelSection = field(default_factory=LabelSection)
    split: SplitSection = field(default_factory=SplitSection)

    @classmethod
    def from_toml(cls, text: str) -> Recipe:
        data: dict[str, Any] = tomllib.loads(text)
        kinds = {"dicom": DicomSection, "presentation": PresentationSection, "image": ImageSection, "labels": LabelSection, "split": SplitSection}
        parts = {}
        for key, kind in kinds.items():
            known = {f.name for f in fields(kind)}
            section = {k: tuple(v) if isinstance(v, list) else v for k, v in data.get(key, {}).items() if k in known}
            parts[key] = kind(**section)
        return cls(data.get("name", ""), **parts).checked()

    def checked(self) -> Recipe:
        if not self.name.strip():
            raise ValueError("a recipe needs a name")
        if len(self.image.size) != 2 or self.image.size[0] != self.image.size[1] or self.image.size[0] <= 0:
            raise ValueError("images must be square and larger than nothing")
        if not self.labels.targets or any(not t.strip() for t in self.labels.targets):
            raise ValueError("a recipe needs label targets with names")
        for policy in (self.labels.uncertain, self.labels.missing):
            if policy not in POLICIES:
                raise ValueError(f"unknown label policy {policy!r}")
        if self.dicom.unsupported_transfer_syntax not in ("fail", "warn", "skip"):
            raise ValueError("transfer syntaxes: fail, warn or skip")
        if self.split.by != "patient_id":
            raise ValueError("splits go by patient_id")
        check_ratios((self.split.train, self.split.val, self.split.test))
        return self

    @property
    def fingerprint(self) -> str:
        return stable_hash(asdict(self))


def may_resume(state: dict[str, str] | None, now: dict[str, str]) -> bool:
    """Whether an earlier run's inputs are all the same as this one's."""
    return state is not None and state.keys() == now.keys() and all(state[k] == now[k] for k in now)
