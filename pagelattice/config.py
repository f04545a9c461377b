"""Options: names, defaults and where values come from (a call's own, then the environment, then the default)."""

from __future__ import annotations

import os
from typing import Any

#: Options of a run.
RUN: dict[str, Any] = {"out_dir": None, "progress": False, "split_chars": 0, "render_scale": 2.0, "render_pages": True, "read_pictures": True} | {"fill_all": False, "assess_tables": True, "fill_tables": True}
#: Options of providers and sources.
PROVIDER: dict[str, Any] = {
    "llm_url": "", "llm_model": "", "llm_key": "", "llm_timeout": 60.0, "llm_concurrency": 8, "llm_adapter": "",
    "fallback_enabled": False, "fallback_url": "", "fallback_model": "", "fallback_key": "", "fallback_timeout": 60.0, "openai_key": "",
    "vlm_model": "", "vlm_device": "auto", "vlm_dtype": "auto", "vlm_max_tokens": 2048, "vlm_fix_tables": False,
    "picture_enabled": False, "picture_url": "", "picture_model": "", "picture_key": "", "picture_area_threshold": 0.03,
    "pdf_backend": "", "ocr_backend": "", "ocr_lang": "ko,en", "force_full_page_ocr": False, "korean_ocr": True, "rapidocr_runtime": "onnxruntime",
    "generate_parsed_pages": False, "code_formula_enrichment": False, "hwp_fill_html": False, "flag_broken_tables": True, "device": "auto", "num_threads": 4, "threaded_pipeline": True,
}
SECRETS = frozenset(k for k in PROVIDER if k.endswith("_key"))
PREFIX = "PAGELATTICE_"


def option_keys() -> tuple[str, ...]:
    return tuple(sorted({**RUN, **PROVIDER}))


def defaults() -> dict[str, Any]:
    return {**RUN, **PROVIDER}


def check(key: str) -> str:
    if key not in RUN and key not in PROVIDER:
        raise KeyError(f"no option {key!r}; there are {', '.join(option_keys())}")
    return key


def convert(key: str, value: Any) -> Any:
    """A text as the kind of value that the option's default has; texts that don't fit give the default."""
    default = defaults()[check(key)]
    if not isinstance(value, str) or default is None or isinstance(default, str):
        return value
    try:
        if isinstance(default, bool):
            return value.strip().lower() in ("1", "true", "yes", "on")
        return type(default)(value)
    except ValueError:
        return default


def resolve(own: dict[str, Any] | None = None) -> dict[str, Any]:
    """All options with their values."""
    out = defaults()
    for key in out:
        if (env := os.environ.get(PREFIX + key.upper())) is not None:
            out[key] = convert(key, env)
    for key, value in (own or {}).items():
        out[check(key)] = convert(key, value)
    return out


#: What recognisers call languages.
_NAMES = {"rapidocr": {"ko": "korean", "en": "english", "ja": "japan", "zh": "chinese"}, "tesseract": {"ko": "kor", "en": "eng", "ja": "jpn", "zh": "chi_sim"}}


def layout_options(o: dict[str, Any]) -> dict[str, Any]:
    """What a layout reader of another package (register it by files.register_reader) is to be set to; languages as its recogniser calls them."""
    ocr = (o["ocr_backend"] or "rapidocr").lower()
    langs = [_NAMES.get(ocr if ocr in ("rapidocr", "easyocr", "auto") else "tesseract", {}).get(x, x) for x in (p.strip() for p in o["ocr_lang"].split(",")) if x]
    recogniser = {"backend": ocr, "languages": langs, "full_page": o["force_full_page_ocr"]} | ({"runtime": o["rapidocr_runtime"]} if ocr == "rapidocr" else {})
    model = {"name": o["vlm_model"], "device": o["device"] if o["vlm_device"] == "auto" else o["vlm_device"], "dtype": o["vlm_dtype"], "max_tokens": o["vlm_max_tokens"]} if o["vlm_model"] else None
    return {"recogniser": recogniser, "backend": o["pdf_backend"] or "auto", "device": o["device"], "threads": o["num_threads"] or None, "threaded": o["threaded_pipeline"], "keep_cells": o["generate_parsed_pages"], "formulas": o["code_formula_enrichment"], "model": model, "tables": True, "pictures": True}


def mask(value: str) -> str:
    """A secret as it may be shown."""
    short = len(value) <= 10
    return "*" * len(value) if short else "…".join((value[:6], value[-4:]))


def shown(options: dict[str, Any]) -> dict[str, Any]:
    return {k: mask(str(v)) if k in SECRETS and v else v for k, v in options.items()}
