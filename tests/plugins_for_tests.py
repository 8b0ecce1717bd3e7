"""Plug-ins that other processes import."""

import numpy as np

FOLDERS = {"top": [{"id": "d1", "name": "sub", "folder": True}] + [{"id": f"f{k}", "name": f"a{k}.JPG", "length": k} for k in range(5)] + [{"id": "t", "name": "notes.txt"}], "d1": [{"id": "g", "name": "deep.png", "length": None}, {"id": "d2", "name": "deeper", "folder": True}], "d2": [{"id": "h", "name": "too_deep.png"}]}


def list_folder(folder, token, page):
    at = token or 0
    rows = FOLDERS[folder]
    return rows[at : at + page], at + page if at + page < len(rows) else None


class Frames:
    def __init__(self, options):
        self.left = int(options["frames"])

    def open(self):
        pass

    def read(self):
        self.left -= 1
        return (bytes([self.left]) * 12, 2, 2) if self.left >= 0 else None

    def close(self):
        pass


def hashes_of(url):
    return None if "bad" in url else ("0" * 64,) * 3


def raw_bytes(pixels):
    return np.asarray(pixels).tobytes()
