"""corpusloom: labelled-text datasets on PySpark DataFrames."""
