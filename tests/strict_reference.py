"""The strict decoder in plain Python: what the Spark expressions must equal."""

from __future__ import annotations

import json

_REF_SHAPE = {"path": "str", "reason": "str"}


class _Reject(Exception):
    pass


def _reject_constant(_):
    raise _Reject()


def _decode_object(pairs, shape: dict) -> dict:
    out = {k: ("" if v == "str" else []) for k, v in shape.items()}
    folded = {k.casefold(): k for k in shape}
    for key, value in pairs:
        name = folded.get(key.casefold())
        if name is None:
            continue
        kind = shape[name]
        if kind == "str":
            if value is None:
                continue
            if not isinstance(value, str):
                raise _Reject()
            out[name] = value
        elif value is None:
            out[name] = []
        elif not isinstance(value, list) or isinstance(value, _Pairs):
            raise _Reject()
        elif kind == "list":
            items = []
            for item in value:
                if item is None:
                    items.append("")
                elif isinstance(item, str):
                    items.append(item)
                else:
                    raise _Reject()
            out[name] = items
        else:
            refs = []
            for item in value:
                if item is None:
                    refs.append({"path": "", "reason": ""})
                elif isinstance(item, _Pairs):
                    refs.append(_decode_object(item, _REF_SHAPE))
                else:
                    raise _Reject()
            out[name] = refs
    return out


class _Pairs(list):
    """Ordered key/value pairs of one JSON object (duplicates preserved)."""


def canonical_json(text: str | None, shape: dict) -> str | None:
    """Validate ``text`` against ``shape``; canonical JSON or None."""
    if text is None:
        return None
    try:
        doc = json.loads(text, object_pairs_hook=_Pairs, parse_constant=_reject_constant)
    except (ValueError, _Reject, RecursionError):
        return None
    try:
        if doc is None:
            obj = _decode_object([], shape)
        elif isinstance(doc, _Pairs):
            obj = _decode_object(doc, shape)
        else:
            return None
    except _Reject:
        return None
    # An unpaired surrogate escape has no UTF-8 form; it decodes to U+FFFD.
    return json.dumps(obj, ensure_ascii=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
