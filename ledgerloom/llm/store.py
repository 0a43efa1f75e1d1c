"""Tables in the folder that all machines share, as in the rest of the library."""

from ledgerloom.store import drop, new_path, recording, release, shared_folder, written

__all__ = ["drop", "new_path", "recording", "release", "shared_folder", "written"]
