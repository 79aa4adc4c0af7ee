"""Where browsers keep their history below a home directory."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (product, packaging, pattern below the home directory).
PROFILE_PATTERNS = (
    ("chrome", "linux", ".config/google-chrome/*/History"),
    ("chrome", "flatpak-linux", ".var/app/com.google.Chrome/config/google-chrome/*/History"),
    ("chrome", "macos", "Library/Application Support/Google/Chrome/*/History"),
    ("chrome", "windows", "AppData/Local/Google/Chrome/User Data/*/History"),
    ("chromium", "linux", ".config/chromium/*/History"),
    ("chromium", "flatpak-linux", ".var/app/org.chromium.Chromium/config/chromium/*/History"),
    ("edge", "linux", ".config/microsoft-edge/*/History"),
    ("edge", "flatpak-linux", ".var/app/com.microsoft.Edge/config/microsoft-edge/*/History"),
    ("firefox", "linux", ".mozilla/firefox/*/places.sqlite"),
    ("firefox", "snap-linux", "snap/firefox/*/.mozilla/firefox/*/places.sqlite"),
    ("firefox", "flatpak-linux", ".var/app/org.mozilla.firefox/.mozilla/firefox/*/places.sqlite"),
    ("firefox", "macos", "Library/Application Support/Firefox/Profiles/*/places.sqlite"),
    ("firefox", "windows", "AppData/Roaming/Mozilla/Firefox/Profiles/*/places.sqlite"),
    ("safari", "macos", "Library/Safari/History.db"),
    ("brave", "macos", "Library/Application Support/BraveSoftware/Brave-Browser/*/History"),
    ("brave", "linux", ".config/BraveSoftware/Brave-Browser/*/History"),
    ("brave", "flatpak-linux", ".var/app/com.brave.Browser/config/BraveSoftware/Brave-Browser/*/History"),
    ("brave", "windows", "AppData/Local/BraveSoftware/Brave-Browser/*/History"),
)


def _path_regex(pattern: str) -> str:
    parts = (r"\Q" + literal + r"\E" for literal in pattern.split("*"))
    return "(^|/)" + "[^/]+".join(parts) + "$"


def _first_match(data_path: Column, answer) -> Column:
    # Longest pattern first: a snap or flatpak path also ends like a plain one.
    out = None
    for product, packaging, pattern in sorted(PROFILE_PATTERNS, key=lambda p: -len(p[2])):
        test = data_path.rlike(_path_regex(pattern))
        value = F.lit(answer(product, packaging))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def product_of(data_path: Column) -> Column:
    """Browser product a history file belongs to; NULL for other paths."""
    return _first_match(data_path, lambda product, packaging: product)


def packaging_of(data_path: Column) -> Column:
    """Operating system and packaging of the path; NULL for other paths."""
    return _first_match(data_path, lambda product, packaging: packaging)


def patterns_below(home: str) -> list[str]:
    return [home.rstrip("/") + "/" + pattern for _, _, pattern in PROFILE_PATTERNS]
