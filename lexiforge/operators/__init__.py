"""Table operators: pairs.py, selection.py, oov.py, knowledge.py, calibration.py, models.py, wordnet.py."""
