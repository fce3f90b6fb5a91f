"""Granule containers in memory, as either library shows them; a path names one in ``FILES``."""

from __future__ import annotations

import numpy as np

FILES: dict[str, object] = {}


class Variable:
    """Has ``attrs`` (one library) or ``ncattrs`` (the other)."""

    def __init__(self, data, netcdf: bool, **attrs):
        self.data, self.shape, self.dtype, self.closed = np.asarray(data), np.shape(data), np.asarray(data).dtype, False
        if netcdf:
            self.ncattrs, self.getncattr = lambda: list(attrs), attrs.__getitem__
        else:
            self.attrs = attrs

    def __getitem__(self, key):
        return self.data[key]


class Group:
    """A group of the library that walks ``groups`` and ``variables``."""

    def __init__(self):
        self.groups, self.variables, self.dimensions = {}, {}, {}
        self.closed, self.attributes = False, {"title": "granule"}

    def ncattrs(self):
        return list(self.attributes)

    def getncattr(self, name):
        return self.attributes[name]

    def close(self):
        self.closed = True


class Tree(dict):
    """A file of the library that takes paths."""

    attrs = {"title": "granule"}
    closed = False

    def __getitem__(self, path):
        at = self
        for part in path.split("/"):
            at = dict.__getitem__(at, part)
        return at

    def close(self):
        self.closed = True


def container(netcdf: bool, variables: dict[str, tuple]) -> object:
    """``variables``: path -> (array, attributes)."""
    root = Group() if netcdf else Tree()
    for path, (data, attrs) in variables.items():
        *groups, name = path.split("/")
        at = root
        for g in groups:
            at = at.groups.setdefault(g, Group()) if netcdf else at.setdefault(g, Tree())
        v = Variable(data, netcdf, **attrs)
        if netcdf:
            at.variables[name] = v
            at.dimensions.update(lines=range(v.shape[0]), samples=range(v.shape[1]))
        else:
            dict.__setitem__(at, name, v)
    return root


def open_file(path: str):
    name = path.rsplit("/", 1)[-1]
    if name not in FILES:
        raise OSError(f"cannot open {name}")
    return FILES[name]
