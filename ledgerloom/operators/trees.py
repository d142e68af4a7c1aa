"""Maps over the texts of a JSON value, to any depth, without recursion."""

from __future__ import annotations

from typing import Callable, Collection


def map_texts(value: object, make: Callable[[str | None, str], str], leave: Collection[str] = ()) -> object:
    """A copy of ``value`` with each text replaced by ``make(field, text)``, in reading order; ``field`` is the name of the object's
    field that holds the text itself, None in an array. Field names stay; fields named in ``leave`` stay whole."""
    out: list = [None]
    todo: list[tuple] = [(out, 0, None, value)]
    while todo:
        holder, at, field, v = todo.pop()
        if isinstance(v, str):
            holder[at] = make(field, v)
        elif isinstance(v, dict):
            new: dict = {k: None for k in v}
            holder[at] = new
            for k, x in v.items():
                if k in leave:
                    new[k] = x
            todo += [(new, k, k, x) for k, x in reversed(v.items()) if k not in leave]
        elif isinstance(v, list):
            new_list: list = [None] * len(v)
            holder[at] = new_list
            todo += [(new_list, i, None, v[i]) for i in range(len(v) - 1, -1, -1)]
        else:
            holder[at] = v
    return out[0]
