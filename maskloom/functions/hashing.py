"""Checksums, signatures and seeded ordering keys."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def combined_checksum(*hex_digests: Column) -> Column:
    """SHA-256 over the concatenated hex digests."""
    return F.sha2(F.concat(*hex_digests), 256)


def signature16(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def canonical_json(value: dict) -> str:
    """Sorted keys, no spaces: the text form that keys and signatures are hashed from."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def json_text(value: Column) -> Column:
    """A string column as a JSON string literal."""
    quoted = F.to_json(F.array(value))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def analysis_dedupe_key(workspace: Column, model: Column, images: Column, config: Column) -> Column:
    """Hash of an analysis request.  ``images`` order and blanks do not matter.

    ``config`` is canonical JSON text.  Keys are written in sorted order.
    """
    trimmed = F.transform(images, lambda name: F.trim(name))
    cleaned = F.array_sort(F.filter(trimmed, lambda name: name != ""))
    text = F.concat(
        F.lit('{"input_images":'), F.to_json(cleaned),
        F.lit(',"kind":"analysis","model_id":'), model.cast("string"),
        F.lit(',"postprocess_config":'), config,
        F.lit(',"workspace_id":'), workspace.cast("string"), F.lit("}"),
    )
    return F.sha2(text, 256)


def training_dedupe_key(
    workspace: Column, model_name: Column, dataset: Column, features: Column, train: Column
) -> Column:
    text = F.concat(
        F.lit('{"dataset_id":'), dataset.cast("string"),
        F.lit(',"feature_config":'), features,
        F.lit(',"kind":"training","model_name":'), json_text(F.trim(model_name)),
        F.lit(',"train_config":'), train,
        F.lit(',"workspace_id":'), workspace.cast("string"), F.lit("}"),
    )
    return F.sha2(text, 256)


def warmup_dedupe_key(workspace: Column, dataset: Column) -> Column:
    text = F.concat(
        F.lit('{"dataset_id":'), dataset.cast("string"),
        F.lit(',"kind":"slic_warmup","workspace_id":'), workspace.cast("string"), F.lit("}"),
    )
    return F.sha2(text, 256)


def seeded_key(seed: int, *keys: Column) -> Column:
    """Uniform 32-hex ordering key: the same in every engine and under any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(int(seed))), *[k.cast("string") for k in keys]))


def seeded_unit(seed: int, *keys: Column) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits (52 bits) of the ordering key."""
    digits = F.substring(seeded_key(seed, *keys), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))
