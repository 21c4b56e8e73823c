"""Study metadata: samples, pedigrees and cohorts on the driver, carried by a DataFrame as column metadata."""

from __future__ import annotations

import gzip
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from .errors import HelixError

KEY = "helixframe"


@dataclass
class Member:
    sample: str
    family: str = ""
    father: str = ""
    mother: str = ""
    sex: str = ""
    phenotype: str = ""
    annotations: dict = field(default_factory=dict)


@dataclass
class Study:
    id: str
    members: list[Member] = field(default_factory=list)
    cohorts: dict[str, list[str]] = field(default_factory=dict)
    files: dict[str, list[str]] = field(default_factory=dict)

    @property
    def samples(self) -> list[str]:
        return [m.sample for m in self.members]

    def index(self, sample: str) -> int:
        """Position of a sample in samplesData."""
        try:
            return self.samples.index(sample)
        except ValueError:
            raise HelixError.unknown_sample(self.id, sample, self.samples) from None

    def indexes(self, samples) -> list[int]:
        return [self.index(s) for s in samples]

    def member(self, sample: str) -> Member:
        return self.members[self.index(sample)]

    def family(self, name: str) -> list[Member]:
        found = [m for m in self.members if m.family == name]
        if not found:
            raise HelixError.unknown_family(name, {m.family for m in self.members})
        return found


@dataclass
class Metadata:
    studies: dict[str, Study] = field(default_factory=dict)

    def study(self, study: str = "") -> Study:
        """A study by id; without an id the only one there is."""
        if study:
            if study not in self.studies:
                raise HelixError.unknown_study(study, self.studies)
            return self.studies[study]
        if len(self.studies) != 1:
            raise HelixError.missing_study(self.studies)
        return next(iter(self.studies.values()))

    def first(self, study: str = "") -> Study:
        return self.study(study or next(iter(self.studies), ""))

    @staticmethod
    def parse(data: dict) -> Metadata:
        """From the side file's JSON: studies with individuals (samples in order), cohorts and files."""
        found = Metadata()
        for s in data.get("studies") or []:
            study = Study(s["id"])
            for who in s.get("individuals") or []:
                for sample in who.get("samples") or []:
                    notes = {str(k): str(v) for k, v in (sample.get("annotations") or {}).items()}
                    text = lambda k, who=who: who.get(k) if isinstance(who.get(k), str) else (who.get(k) or {}).get("id", "") if isinstance(who.get(k), dict) else ""
                    study.members.append(Member(sample["id"], text("family") or "", text("father") or "", text("mother") or "", text("sex") or "", text("phenotype") or "", notes))
            for c in s.get("cohorts") or []:
                study.cohorts[c["id"]] = list(c.get("sampleIds") or [])
            for f in s.get("files") or []:
                study.files[f["id"]] = list(f.get("sampleIds") or [])
            found.studies[study.id] = study
        return found

    def as_dict(self) -> dict:
        return {k: asdict(s) for k, s in self.studies.items()}

    @staticmethod
    def from_dict(data: dict) -> Metadata:
        return Metadata({k: Study(s["id"], [Member(**m) for m in s["members"]], dict(s["cohorts"]), dict(s["files"])) for k, s in data.items()})


def read_metadata(path: str) -> Metadata | None:
    """From <path>.meta.json.gz or <path>.meta.json; None where neither is there."""
    for name, opener in ((f"{path}.meta.json.gz", gzip.open), (f"{path}.meta.json", open)):
        if Path(name).exists():
            with opener(name, "rt", encoding="utf-8") as f:
                return Metadata.parse(json.load(f))
    return None


def attach(df: DataFrame, metadata: Metadata) -> DataFrame:
    """df with the metadata on its column studies; it survives selects, filters and Parquet."""
    return df.withMetadata("studies", {KEY: json.dumps(metadata.as_dict())})


def metadata_of(df: DataFrame) -> Metadata:
    held = df.schema["studies"].metadata.get(KEY) if "studies" in df.columns else None
    if held is None:
        raise HelixError("The DataFrame carries no study metadata; attach() it first")
    return Metadata.from_dict(json.loads(held))


def studies(df: DataFrame) -> list[str]:
    return list(metadata_of(df).studies)


def samples(df: DataFrame, study: str | None = None):
    found = metadata_of(df)
    return {k: s.samples for k, s in found.studies.items()} if study is None else found.study(study).samples


def pedigrees(df: DataFrame, study: str | None = None):
    """Families of each study, or of one: {family: [member]}."""

    def of(s: Study) -> dict[str, list[Member]]:
        out: dict[str, list[Member]] = {}
        for m in s.members:
            out.setdefault(m.family, []).append(m)
        return out

    found = metadata_of(df)
    return {k: of(s) for k, s in found.studies.items()} if study is None else of(found.study(study))


def pedigree(df: DataFrame, study: str, family: str) -> list[Member]:
    return metadata_of(df).study(study).family(family)
