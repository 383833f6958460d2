"""Focused search: a query is narrowed to documents outside system folders.

Each top-level OR group gets exclusions of noise paths unless it names a location itself, and one
list of extensions unless it names a type itself.
"""

from __future__ import annotations

import re

#: Fixed values.
EXCLUDE_PATHS = ("\\windows\\", "\\program files", "\\programdata\\", "\\$recycle.bin\\", "\\node_modules\\", "\\.git\\", "\\__pycache__\\")
#: Fixed values.
EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "csv",
    "jpg", "jpeg", "png", "gif", "webp", "svg", "heic",
    "mp3", "wav", "flac", "m4a",
    "mp4", "mkv", "mov", "avi",
    "zip", "7z", "rar",
    "exe", "msi", "lnk",
)


def focused(text: str, exclude_paths: tuple[str, ...] = EXCLUDE_PATHS, extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """The narrowed query; a blank one stays as it is."""
    if not text.strip():
        return text
    away = "".join(f' !path:"{p}"' for p in exclude_paths if p and '"' not in p)
    kinds = ";".join(e for e in extensions if re.fullmatch(r"[^\s;,|\"]+", e))
    # an unclosed quote reaches to the end, and so does its group
    groups = re.findall(r'(?:[^|"]|"[^"]*(?:"|$))*(?:\||$)', text)
    out = []
    for group in groups[: text.count("|") + 1]:
        group, ended = (group[:-1], True) if group.endswith("|") else (group, False)
        group = group.strip()
        low = group.lower()
        more = "" if "path:" in low or "\\" in low else away
        more += "" if "ext:" in low or "regex:" in low or not kinds else f" ext:{kinds}"
        out.append(group + more)
        if not ended:
            break
    return " | ".join(out)
