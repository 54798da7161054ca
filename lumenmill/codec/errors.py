"""What can be wrong with an image; a code, and a detail where there is one."""

from __future__ import annotations


class CodecError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(code if not detail else f"{code}: {detail}")
        self.code, self.detail = code, detail
