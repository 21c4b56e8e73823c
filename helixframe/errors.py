"""One exception class; its constructors carry the messages of every refusal."""

from __future__ import annotations


class HelixError(ValueError):
    @classmethod
    def missing_study(cls, studies=()) -> HelixError:
        return cls(f"Missing study. Select one of: {sorted(studies)}")

    @classmethod
    def missing_param(cls, name: str) -> HelixError:
        return cls(f"Missing param '{name}'")

    @classmethod
    def unknown_study(cls, study: str, studies=()) -> HelixError:
        return cls(f"Unknown study '{study}'. Select one of: {sorted(studies)}")

    @classmethod
    def unknown_family(cls, family: str, families=()) -> HelixError:
        return cls(f"Unknown family '{family}'. Select one of: {sorted(families)}")

    @classmethod
    def unknown_sample(cls, study: str, sample: str, samples=()) -> HelixError:
        return cls(f"Sample '{sample}' not found in study '{study}'. Known samples: {list(samples)}")

    @classmethod
    def unsupported_format(cls, path: str) -> HelixError:
        return cls(f"Unsupported format for file {path}")

    @classmethod
    def no_avro_source(cls, path: str) -> HelixError:
        return cls(f"Reading {path} needs Spark's avro source; start the session with the spark-avro package")
