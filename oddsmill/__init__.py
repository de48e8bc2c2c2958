"""Prediction-market analytics and training-data operators on Spark DataFrames."""
