"""Part of voxelframe."""
