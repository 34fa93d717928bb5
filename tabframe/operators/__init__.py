from tabframe.operators.frame import ColumnInfo, Frame
from tabframe.operators.matrix import Transposed, multiply_long
from tabframe.operators.rowset import NoOrderError, RowSet

__all__ = ["ColumnInfo", "Frame", "NoOrderError", "RowSet", "Transposed", "multiply_long"]
