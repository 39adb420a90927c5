"""voxelframe: segmentation analytics over tables of voxels, labels and graphs, on Spark."""
