"""Readers and writers for voxel worlds, clouds, trajectories and catalogues."""
