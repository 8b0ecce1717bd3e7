"""Hooks for what needs devices or libraries: recognition, text recognition, fetching, cameras, machines.

A plug-in registers a function under a name. Asking for one that isn't there is
an error that says so; nothing is skipped silently.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import truthy

KINDS = ("decode", "encode", "ocr", "warp", "circles", "fetch", "recognise", "camera", "device", "listing")
_registry: dict[tuple[str, str], Callable] = {}


class MissingPlugin(LookupError):
    """No plug-in of this kind and name."""


def register(kind: str, name: str, function: Callable) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    _registry[kind, name] = function


def get(kind: str, name: str) -> Callable:
    try:
        return _registry[kind, name]
    except KeyError:
        have = [n for k, n in _registry if k == kind]
        raise MissingPlugin(f"no {kind} plug-in {name!r}; registered: {', '.join(have) or 'none'}") from None


def loaded(kind: str, name: str) -> Callable:
    """A registered plug-in, or the function ``module:function``, which other processes can import too."""
    if (kind, name) in _registry:
        return _registry[kind, name]
    if ":" in name:
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)
    return get(kind, name)


def discover(package: str) -> list[str]:
    """Register the ``Plugin`` of every module of a package under the module's name, by its ``kind``; a module that fails to load is an error."""
    done = []
    for found in pkgutil.iter_modules(importlib.import_module(package).__path__):
        module = importlib.import_module(f"{package}.{found.name}")
        if hasattr(module, "Plugin"):
            register(module.Plugin.kind, getattr(module.Plugin, "name", found.name), module.Plugin)
            done.append(found.name)
    return sorted(done)


def fetched_hashes(cards: DataFrame, index: DataFrame, plugin: str) -> DataFrame:
    """(product_id, game, r_phash, g_phash, b_phash) of cards with an image that the index lacks, by a ``fetch`` plug-in.

    The plug-in takes the address of an image and gives three hashes, or None.
    """
    fetch = loaded("fetch", plugin)
    missing = cards.where(truthy(F.col("image_url")).isNotNull()).join(index.select("product_id"), "product_id", "left_anti").dropDuplicates(["product_id"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = [fetch(url) or (None,) * 3 for url in frame["image_url"]]
            yield frame[["product_id", "game"]].assign(**{f"{c}_phash": [h[k] for h in hashes] for k, c in enumerate("rgb")})

    kinds = "product_id string, game string, r_phash string, g_phash string, b_phash string"
    return missing.select("product_id", "game", "image_url").mapInPandas(run, kinds).where("r_phash IS NOT NULL")


def or_built_in(plugin: Column, built_in: Column) -> Column:
    """A plug-in's recognition where it gave one, else the built-in one."""
    return F.coalesce(plugin, built_in)


def send_bins(routed: DataFrame, device: str, order: list[str]) -> int:
    """Send the bins of a micro-batch to a device in order, each after the reply to the one before; for ``foreachBatch``, where a batch is what a machine sorts in seconds."""
    send, sent = get("device", device), 0
    for row in routed.orderBy(*order).select("bin").toLocalIterator():
        if send(row["bin"]) is False:  # the device's reply
            raise RuntimeError(f"device {device!r} refused bin {row['bin']!r} after {sent}")
        sent += 1
    return sent
