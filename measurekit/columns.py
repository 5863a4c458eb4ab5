"""Column names every operator agrees on."""

ROW = "row_id"
KEY = "entity"
TYPE = "target_type"
Y = "target"
REPEAT = "repeat"
FOLD = "fold"
MODEL = "model"
PRED = "pred"
