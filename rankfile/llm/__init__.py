"""Training-data operators: ten DataFrame operators that clean, mix, index and pack text corpora."""
