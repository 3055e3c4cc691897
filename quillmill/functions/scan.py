"""Running passes over arrays inside a row, in time linear in the array."""

from __future__ import annotations

#: Items to a run: results are gathered in runs, for appending to one immutable array costs the square of its length.
RUN = 64


def scanned(items: str, state: str, kind: str, value: str, after: str, keep: str = "true") -> str:
    """SQL of an array<kind>: `value` for each item that `keep`, with the state `s` before the item `x`; the state begins as `state` and goes on as `after`."""
    own = f"if({keep}, concat(_one.own, array({value})), _one.own)"
    run = f"""aggregate(slice(_items, _run * {RUN} + 1, {RUN}), named_struct('s', _all.s, 'own', cast(array() as array<{kind}>)),
      (_one, x) -> transform(array(_one.s), s -> named_struct('s', {after}, 'own', {own}))[0])"""
    return f"""transform(array({items}), _items -> flatten(aggregate(
      if(size(_items) > 0, sequence(0, (size(_items) - 1) div {RUN}), cast(array() as array<int>)),
      named_struct('s', {state}, 'out', cast(array() as array<array<{kind}>>)),
      (_all, _run) -> transform(array({run}), _done -> named_struct('s', _done.s, 'out', concat(_all.out, array(_done.own))))[0],
      _all -> _all.out)))[0]"""
