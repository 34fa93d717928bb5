from tabframe.sources.loaders import infer_datetimes, load_parts
from tabframe.sources.workspace import MissingTableError, Workspace

__all__ = ["MissingTableError", "Workspace", "infer_datetimes", "load_parts"]
