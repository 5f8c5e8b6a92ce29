"""Writers for point clouds, frames and scene catalogues."""
