"""The lock of a store's writer: it ends with its holder."""

from __future__ import annotations

import json
import os
import socket
import threading
import uuid

from ..errors import LockedError
from .files import Files

LOCK = "_lock"
#: Seconds after which a lock that is not renewed is its holder's no more.
LEASE = 120.0


def _dead(text: str) -> bool:
    """Whether a lock's holder is a process of this machine that is gone."""
    try:
        own = json.loads(text)
        if own["host"] != socket.gethostname():
            return False
        os.kill(own["pid"], 0)
    except ProcessLookupError:
        return True
    except (ValueError, KeyError, TypeError, OSError):
        return False
    return False


class Lock:
    """Held from its making to :meth:`release`; renewed meanwhile.

    A lock whose process is gone, or that was not renewed for LEASE seconds, is taken over.  The lock keeps writers from
    working in vain; that no commit is lost rests on publishing, which never overwrites.
    """

    def __init__(self, files: Files):
        self.files, self.token = files, uuid.uuid4().hex
        text = json.dumps({"token": self.token, "host": socket.gethostname(), "pid": os.getpid()})
        if not files.create(LOCK, text):
            self._take_over(text)
        self.ended = threading.Event()
        threading.Thread(target=self._renew, daemon=True).start()

    def _take_over(self, text: str) -> None:
        try:
            old = self.files.read(LOCK)
            stale = _dead(old) or self.files.age(LOCK) > LEASE
        except Exception:  # it went meanwhile
            old, stale = None, True
        if stale and old is not None:
            # whoever moves it away has it; one that is not the old one goes back
            aside = f"{LOCK}.{self.token}"
            if self.files.rename(LOCK, aside):
                if self.files.read(aside) == old:
                    self.files.delete(aside)
                else:
                    self.files.rename(aside, LOCK)
        if not stale or not self.files.create(LOCK, text):
            raise LockedError(f"another writer has {self.files.root}")

    def _renew(self) -> None:
        while not self.ended.wait(LEASE / 4):
            try:
                self.files.touch(LOCK)
            except Exception:  # the session has ended, or the lock has
                return

    def release(self) -> None:
        self.ended.set()
        try:
            if json.loads(self.files.read(LOCK))["token"] != self.token:
                return
        except Exception:
            return
        self.files.delete(LOCK)
