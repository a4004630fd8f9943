"""Options with defaults."""

from __future__ import annotations


def with_defaults(given: dict | None, defaults: dict, at: str = "") -> dict:
    """given over defaults, section by section; what the defaults don't know is an error, and so is a value of another kind."""
    given = given or {}
    if unknown := sorted(set(given) - set(defaults)):
        raise KeyError(f"no such option: {', '.join(at + k for k in unknown)}")
    out = {}
    for k, v in defaults.items():
        if k not in given or given[k] is None:
            out[k] = dict(v) if isinstance(v, dict) else v
        elif isinstance(v, dict):
            out[k] = with_defaults(given[k], v, f"{at}{k}.")
        elif v is not None and not isinstance(given[k], type(v)) and not (isinstance(v, float) and isinstance(given[k], int)):
            raise TypeError(f"{at}{k} must be {type(v).__name__}")
        else:
            out[k] = given[k]
    return out


#: What a comparison of runs takes if it isn't told otherwise.
COMPARISON = {"sampling": {"per_instance": 20, "cap": 20, "seed": "s"}, "report": {"min_baseline": 1, "draws": 20_000, "seed": 0}, "streaming": {"late": "10 minutes"}}
