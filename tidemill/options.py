"""Typed options of a job, from a dataclass and a command line."""

from __future__ import annotations

import argparse
import dataclasses
import typing
from collections.abc import Sequence

T = typing.TypeVar("T")


def parse_options(kind: type[T], argv: Sequence[str] | None = None) -> T:
    """kind's fields from --name value; fields without a default are required, metadata["help"] describes them."""
    hints = typing.get_type_hints(kind)
    parser = argparse.ArgumentParser(description=kind.__doc__)
    for f in dataclasses.fields(kind):
        missing = f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
        hint = next((a for a in typing.get_args(hints[f.name]) if a is not type(None)), hints[f.name])
        how = {"action": argparse.BooleanOptionalAction} if hint is bool else {"type": hint}
        default = None if missing else f.default if f.default is not dataclasses.MISSING else f.default_factory()
        parser.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, required=missing, default=default, help=f.metadata.get("help"), **how)
    return kind(**vars(parser.parse_args(argv)))
