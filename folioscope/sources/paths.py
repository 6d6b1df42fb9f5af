"""Guards for paths and names that come from outside: for one of them on the driver, before anything is read, and
as columns for listings of any length."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may be imported, and what ids are.
LARGEST_IMPORT = 20 << 20
IMPORT_KINDS = (".md", ".jsonl")
SOURCE_ID = r"author:[A-Za-z0-9][A-Za-z0-9._-]{0,127}"
AUTHOR_ID = r"[a-z0-9]+(-[a-z0-9]+)*"


def inside(root: str, candidate: str, must_exist: bool = True) -> Path:
    """``candidate`` under ``root``, links followed; anything that leads out of it is an error."""
    if ".." in Path(candidate).parts:
        raise ValueError(f"path leads out of its folder: {candidate}")
    base = Path(root).resolve(strict=True)
    full = (base / candidate).resolve(strict=must_exist)
    if full != base and base not in full.parents:
        raise ValueError(f"path leads out of its folder: {candidate}")
    return full


def import_file(root: str, name: str) -> Path:
    path = inside(root, name)
    if path.suffix not in IMPORT_KINDS or not path.is_file():
        raise ValueError(f"not a file that can be imported: {name}")
    if os.path.getsize(path) > LARGEST_IMPORT:
        raise ValueError(f"larger than {LARGEST_IMPORT} bytes: {name}")
    return path


def source_id(text: str) -> str:
    """``author:`` and a name of letters, digits, dots, underscores and hyphens, at most 128."""
    if not re.fullmatch(SOURCE_ID, text):
        raise ValueError(f"no source id: {text}")
    return text


def author_id(text: str) -> str:
    if not re.fullmatch(AUTHOR_ID, text):
        raise ValueError(f"author ids are lower-case words joined by hyphens: {text}")
    return text


def import_problem(name: Column, size: Column) -> Column:
    """Why a file of that name below the folder of imports and of that size can't be imported, null if it can: what ``import_file`` asks,
    without a look at the file, so that links are not followed. A null name or size is a problem."""
    kinds = "|".join(k[1:] for k in IMPORT_KINDS)
    leaves = name.startswith("/") | F.array_contains(F.split(name, "/"), "..")
    return (
        F.when(name.isNull() | size.isNull(), "unknown").when(leaves, "outside").when(~name.rlike(rf"[^/]\.({kinds})\z"), "kind").when(size > LARGEST_IMPORT, "size")
    )


def is_source_id(text: Column) -> Column:
    """Whether ``source_id`` takes a text; null is no id."""
    return F.coalesce(text.rlike(rf"\A(?:{SOURCE_ID})\z"), F.lit(False))


def is_author_id(text: Column) -> Column:
    """Whether ``author_id`` takes a text; null is no id."""
    return F.coalesce(text.rlike(rf"\A(?:{AUTHOR_ID})\z"), F.lit(False))
