"""Parameters kept in an INI file."""

from __future__ import annotations

import configparser
from dataclasses import asdict

from loamgrid.operators.validation import Params

SECTION = "parameters"


def save(params: Params, path: str) -> None:
    ini = configparser.ConfigParser()
    ini[SECTION] = {k: str(v) for k, v in asdict(params).items()}
    with open(path, "w", encoding="utf-8") as file:
        ini.write(file)


def load(path: str) -> Params:
    """Parameters of a file; defaults for those that it lacks, and for all if there is no file."""
    ini = configparser.ConfigParser()
    ini.read(path, encoding="utf-8")
    return Params.of(dict(ini[SECTION])) if ini.has_section(SECTION) else Params()
