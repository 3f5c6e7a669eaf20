"""voxelyard: multi-view 3D scene analytics on PySpark DataFrames."""
