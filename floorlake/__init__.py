"""floorlake: floor-plan analytics and corpus operators on Spark DataFrames."""
